"""DataFrame operators: vocabulary metrics, alignment, retrieval, learning, statistics and relations."""
