"""DataFrame operators: frames, groups, ranks, summaries, transforms, distances, draws, fits."""
