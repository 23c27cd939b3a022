"""Operations of a training-data pipeline: filters, scans, classifiers, near duplicates, mixing."""
