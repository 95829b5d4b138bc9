from bazaar.sources.csv import scan_csv
from bazaar.sources.parquet import scan_parquet

__all__ = ["scan_csv", "scan_parquet"]
