"""Running the batch operators over arriving files (Structured Streaming).

The job has no streaming operators of its own (no watermarks, windows or
state): every stage is a DataFrame -> DataFrame function. ``incremental``
applies such a function to each micro-batch of a file stream.
"""

from dayspan.streaming.incremental import file_stream, run_incremental  # noqa: F401
