"""Training-data operators: mixing, deduplication, decontamination, licences,
chat formatting, embeddings, language models, language identification, WARC."""
