"""Record, metric, lineage and ledger operators over DataFrames."""
