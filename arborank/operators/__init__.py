"""DataFrame operators: cleaning, interactions, splits, graphs, text, vectors, scoring, ranking, evaluation."""
