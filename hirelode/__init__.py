"""hirelode: matching of profiles to postings and text-data preparation, as Spark plans."""

__version__ = "0.1.0"
