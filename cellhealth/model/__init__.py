"""The health classifier: training, evaluation, scoring, and its stored form."""
