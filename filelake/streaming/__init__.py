"""Structured Streaming entry points.

The tool reproduced here has no streams of its own; what does arrive
continuously in a lake is inventory deltas and operation-log rows.  These
helpers run the same batch operators over such streams (incremental state in
Spark's state store, exactly-once sinks), so a long-running job can keep the
"what is still pending" and "what does the lake hold" answers current.
"""

from filelake.streaming.live import extension_totals_stream, pending_ops_stream  # noqa: F401
