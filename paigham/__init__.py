"""paigham: message quality, scam analytics and text-corpus operators as PySpark plans."""
