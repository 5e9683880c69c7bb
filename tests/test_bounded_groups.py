"""No list or text of the queries that build one grows with the table."""

from collections import Counter

from pyspark.sql import functions as F

from termdrift.plans import queries

SF_DIR = "/root/testdata/sf0.01"


def test_texts_and_lists_are_bounded(spark, monkeypatch):
    most, parsed, exploded = [], queries.files.parse_ontology, queries.universe.exploded

    def parse(texts, *rest):
        most.append(texts.select(F.max(F.size(F.split("value", "\\[Term\\]")) - 1)).first()[0])
        return parsed(texts, *rest)

    def explode(lists, *rest):
        most.append(lists.select(F.max(F.size(F.split("gene_ids", "\\|")) - 1)).first()[0])
        groups = Counter(r["go_id"] for r in lists.select("go_id").collect())
        assert max(groups.values()) > 1
        return exploded(lists, *rest)

    monkeypatch.setattr(queries.files, "parse_ontology", parse)
    monkeypatch.setattr(queries.universe, "exploded", explode)
    part = queries.table(spark, SF_DIR, "part")
    assert queries.ontology_parse(spark, SF_DIR).count() == part.select("p_partkey").distinct().count() > 500
    assert queries.parallel_explode(spark, SF_DIR).count() == part.count()
    assert len(most) == 2 and max(most) <= 500
