"""noteloom: note-quality analytics and corpus preparation on Spark."""
