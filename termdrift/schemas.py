"""The tables that pass between stages. Column names are those that users of the analysis know."""

from __future__ import annotations

OLD_PAIRS = "entrez_gene_id long, metaedge string, go_id string"
NEW_PAIRS = "go_id string, go_name string, entrez_gene_id long, gene_symbol string"
COMMON_TERMS = "go_id string, no_of_genes_in_hetio_GO_2016 long, no_of_genes_in_GO_2024 long"
ANNOTATIONS = "go_id string, go_name string, go_domain string, gene_ids string, gene_symbols string"
ONTOLOGY = "id string, parents array<string>, namespace string, obsolete boolean"
SIMILARITY = "a string, b string, jaccard double"
OLD_COUNT, NEW_COUNT, GROWTH = "no_of_genes_in_hetio_GO_2016", "no_of_genes_in_GO_2024", "pct_change_genes"
