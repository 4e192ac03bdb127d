"""Readers and writers of fragment, region, annotation, contact, matrix and track files, all as DataFrames."""

from locusmill.sources.readers import *  # noqa: F403
from locusmill.sources.writers import *  # noqa: F403
from locusmill.sources.bigwig import BigWigSource, write_bigwig  # noqa: F401
from locusmill.sources.genomes import chrom_sizes  # noqa: F401
