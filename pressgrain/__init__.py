"""News-signal analytics on Spark: text rules, evidence checks, ledgers and run statistics as DataFrame operators."""
