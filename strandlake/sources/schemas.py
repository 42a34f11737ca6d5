"""Schemas of the files and tables that hold loci, tracks and hits."""




NARROW_PEAK = "chrom string, st long, end long, name string, weight double, strand string, signal double, p double, q double, summit long"
BED3 = "chrom string, st long, end long"
BED4 = "chrom string, st long, end long, gc double"
CHROM_SIZES = "chrom string, size long"
TRACK = "chrom string, start long, end long, value double"
HIT = "chrom string, start long, end long, key string, strand string, score double, peak_index long, imp_frac_score double"
