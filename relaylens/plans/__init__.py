from .pipeline import Index, build_deliveries, distinct_records, to_delivery_rows

__all__ = ["Index", "build_deliveries", "distinct_records", "to_delivery_rows"]
