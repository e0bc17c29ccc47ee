"""Time-coded media analytics on Spark: intervals, peaks, transcripts, cues and state folds."""

__version__ = "0.1.0"
