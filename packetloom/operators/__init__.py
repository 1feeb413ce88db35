"""DataFrame operators: filters, flows, statistics, detectors, chunks, retrieval, reports."""
