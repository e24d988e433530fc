"""The screen is a batch job and has no state of its own. clean_library, fragment, drop_stops, score_peptides with a
table and the label functions are stateless, so they take streaming DataFrames as they are."""
