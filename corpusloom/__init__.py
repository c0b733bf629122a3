"""corpusloom: text-corpus and tokenizer analytics as PySpark DataFrame plans."""
