"""The same folds over file streams."""
