"""Operations of a training-data pipeline: dedup, filters, classifiers, mixing, tokenising."""
