"""The atlas of a graph: all tables that the queries read, built in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociq.plans import bubbles, catalogue, hierarchy, reading, selections, sites, structure, trees, views
from lociq.sources import projection


def build(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Writes what is not there yet or no longer holds, in the order in which the tables need each other, and returns all tables."""
    made = {
        "contigs": projection.contigs, "steps": projection.steps, "reads": projection.reads, "leaf_rep": projection.leaves,
        "nodes": catalogue._boxes, "pairs": catalogue._pairs, "edges": catalogue._edges, "visits": catalogue._visits_by_hap, "reference": catalogue._reference,
        "tree": views.tree, "signed_edges": views.signed_edges, "depths": views.depths,
        "read_parts": reading.parts, "dictionary": selections.dictionary, "contig_lists": selections.contig_lists, "masks": selections.masks,
        "closure": trees.ancestors, "gene_spots": trees.occurrences, "alignments": reading.alignments, "inversions": selections.inversions, "support": views.support, "passages": sites.passages, "grids": sites.grids, "chains": bubbles.chained, "claims": lambda s, d: bubbles.owned(s, d)[0],
        "votes": structure.votes, "settled": lambda s, d: structure.settled(s, d)[0], "pivots": structure.distances, "packed": structure.packed,
        "tree_direct": lambda s, d: hierarchy.direct(s, d)[0], "tree_levels": hierarchy.levels, "tree_built": hierarchy.built,
    }
    tables = {name: f(spark, sf_dir) for name, f in made.items()}
    return tables | dict(zip(("names", "name_lists", "name_sizes"), views.name_index(spark, sf_dir), strict=True))
