from .storage import Store, load_bucketed, partitions_for, read_table, save_bucketed

__all__ = ["Store", "load_bucketed", "partitions_for", "read_table", "save_bucketed"]
