"""Training-data operators: sharding, licence scans, language ID, URL filters,
SimHash near-dedup, WARC derivatives, packing, quality rules, chat formatting
and benchmark decontamination.  Nothing outside this folder imports it."""
