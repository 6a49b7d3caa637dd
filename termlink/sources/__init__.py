from termlink.sources.files import (export_curated, scan_delimited, scan_ignore_list,
                                    scan_jsonl_responses, sink_csv, sink_csv_batches,
                                    sink_jsonl_requests, stage_parquet)

__all__ = ["export_curated", "scan_delimited", "scan_ignore_list", "scan_jsonl_responses",
           "sink_csv", "sink_csv_batches", "sink_jsonl_requests", "stage_parquet"]
