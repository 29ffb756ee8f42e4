"""Operations on corpora for training and evaluating language models. Nothing else in the library imports this package."""
