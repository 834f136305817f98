"""Operations of training-data pipelines on document tables; nothing else in the library needs them."""
