"""Fixed column sets. Positions are 0-based, intervals half-open."""




SITE_DDL = "chrom string, pos int, strand string, context string, n_meth int, n_unmeth int, coverage int, sample string"
COVERAGE_DDL = "chrom string, start int, end int, methyl_percent double, n_meth int, n_unmeth int"
STRANDS_DDL = (
    "chrom string, start int, end int, fwd_m int, fwd_t int, fwd_pct double, rev_m int, rev_t int, rev_pct double, "
    "m int, t int, methyl_percent double"
)
CALL_DDL = "read_id string, chrom string, pos int, status tinyint, base_qual tinyint, mapq tinyint, mate tinyint, strand string, allele string"
