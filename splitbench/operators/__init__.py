"""DataFrame operators: catalogue, sampling, similarity, intervals, statistics, audits."""
