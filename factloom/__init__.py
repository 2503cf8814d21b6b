"""factloom: evidence-bound fact extraction and evaluation on PySpark."""
