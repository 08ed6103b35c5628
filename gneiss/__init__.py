"""gneiss: document and table analytics on Spark."""
