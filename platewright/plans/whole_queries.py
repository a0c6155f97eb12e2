"""Earlier names of queries of reference_queries, which read whole, unaltered texts themselves now."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.plans import reference_queries as Q

_SAME = {
    "match_panels_whole": "match_panels_heuristic", "species_seeds_whole": "species_seeds", "kg_nodes_whole": "kg_nodes", "kg_edges_whole": "kg_edges", "taxon_candidates_whole": "taxon_candidates",
    "taxon_merge_best_whole": "taxon_merge_best", "panel_labels_whole": "panel_labels", "label_tokens_whole": "label_tokens", "caption_figure_number_whole": "caption_figure_number",
    "geology_records_whole": "geology_records", "geology_dedup_whole": "geology_dedup", "ocr_text_by_panel_whole": "ocr_text_by_panel", "caption_page_lookup_whole": "caption_page_lookup",
    "candidate_pages_whole": "neighbour_pages",
}
QUERIES: dict = {new: Q.QUERIES[old] for new, old in _SAME.items()}
ORACLE: dict[str, str] = {new: Q.ORACLE[old] for new, old in _SAME.items()}
_links = Q.paper_links


def species_geology_links_whole(s, d):
    """How often each caption name is linked to rule records of each kind of section."""
    return _links(s, d).groupBy("species", "section_title").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("paper_id").alias("papers"))


QUERIES["species_geology_links_whole"] = species_geology_links_whole
ORACLE["species_geology_links_whole"] = f"WITH {Q._LINKS} SELECT species, section_title, count(*) AS n_links, count(DISTINCT paper_id) AS papers FROM links GROUP BY ALL"
