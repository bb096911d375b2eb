"""Reachability in reason graphs and greedy choice of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


#: Edges that the reason graph may have, and those that it never may.
ALLOWED = ["FORMULATES", "DISCOVERED", "SELECTED", "MAPPED_TO", "FLAGGED_BY", "EXTRACTED_FROM"]
FORBIDDEN = ["SAME_PATIENT", "JOINED_ACROSS_STUDY"]


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node, depth)`` of all nodes that ``edges(src, dst)`` lead to from ``start(node)``, at their least depth.

    A frontier is joined with the edges in each round and visited nodes
    leave; the graph may have cycles and any depth.  Every round is written
    out, and all visited nodes again whenever their number has doubled, so
    that a plan reads few tables.
    """
    seen = written(start.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "seen")
    front, parts, whole, fresh, depth = seen, [], seen.count(), 0, 0
    while True:
        depth += 1
        known = reduce(DataFrame.unionByName, [seen, *parts])
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "front")
        n = front.count()
        if not n:
            return known
        parts.append(front)
        fresh += n
        if fresh > whole or len(parts) >= 16:
            seen, whole, fresh, parts = written(known.unionByName(front), "seen"), whole + fresh, 0, []


def projected(edges: DataFrame) -> DataFrame:
    """``edges(edge_type, src, dst, reason)``, each once; an edge of a type that is not allowed is an error when it is read."""
    kind = F.when(F.col("edge_type").isin(*ALLOWED), F.col("edge_type")).otherwise(F.raise_error(F.concat(F.lit("edge type is not allowed: "), F.coalesce("edge_type", F.lit("null")))))
    return edges.select(kind.alias("edge_type"), "src", "dst", "reason").groupBy("edge_type", "src", "dst").agg(F.max("reason").alias("reason"))


def why(nodes: DataFrame, edges: DataFrame, finding: str) -> DataFrame:
    """``(node, depth, label, reasons)`` of everything that leads to a finding, backwards along the edges.

    ``nodes(node, node_type, label, reasons)``; ``reasons`` of the answer are
    the node's own and those of its edges towards the finding.
    """
    start = nodes.filter((F.col("node") == finding) & (F.col("node_type") == "QualityFinding")).select("node")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    path = reachable(back, start)
    said = edges.join(path.select(F.col("node").alias("dst")), "dst", "left_semi").filter("reason <> ''").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("reason")).alias("said"))
    out = path.join(nodes.select("node", "label", "reasons"), "node", "left").join(said, "node", "left")
    none = F.array().cast("array<string>")
    return out.select("node", "depth", "label", F.concat(F.coalesce("reasons", none), F.coalesce("said", none)).alias("reasons"))


def lineage(papers: DataFrame, questions: DataFrame, chunks: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, node_type, label)`` and edges ``(src, dst, relation)`` of a topic's planning.

    ``papers(paper_id, title, accessions array)``, ``questions(candidate_id,
    question, paper_ids array)``, ``chunks(chunk_id, section, chunk_index,
    paper_id)``.  A node that comes twice keeps its last label by type order;
    edges are distinct.
    """
    spark = papers.sparkSession
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    node = lambda df, n, kind, label: df.select(n.alias("node"), F.lit(kind).alias("node_type"), label.alias("label"))
    edge = lambda df, a, b, relation: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"))
    root = F.lit(f"topic:{topic}")
    used = papers.select("paper_id", F.explode("accessions").alias("accession"))
    backed = questions.select("candidate_id", F.explode("paper_ids").alias("paper_id"))
    nodes = [node(spark.range(1), root, "ResearchTopic", F.lit(topic)), node(papers, name("paper", "paper_id"), "Paper", F.col("title")), node(used, name("dataset", "accession"), "Dataset", F.col("accession"))]
    nodes += [node(questions, name("question", "candidate_id"), "ResearchQuestion", F.col("question")), node(chunks, name("chunk", "chunk_id"), "PaperChunk", F.concat(F.col("section"), F.lit(" #"), (F.col("chunk_index") + 1).cast("string")))]
    edges = [edge(papers, root, name("paper", "paper_id"), "HAS_EVIDENCE_CANDIDATE"), edge(used, name("paper", "paper_id"), name("dataset", "accession"), "USES_DATASET"), edge(questions, root, name("question", "candidate_id"), "FORMULATES")]
    edges += [edge(backed, name("paper", "paper_id"), name("question", "candidate_id"), "SUPPORTS"), edge(chunks, name("chunk", "chunk_id"), name("paper", "paper_id"), "EXTRACTED_FROM")]
    return reduce(DataFrame.unionByName, nodes).groupBy("node", "node_type").agg(F.max("label").alias("label")), reduce(DataFrame.unionByName, edges).distinct()


def related_papers(edges: DataFrame, field_id: str) -> DataFrame:
    """``(paper_id)`` of the papers that define a field."""
    return edges.filter((F.col("dst") == f"field:{field_id}") & (F.col("relation") == "DEFINES") & F.col("src").startswith("paper:")).select(F.expr("substring(src, 7)").alias("paper_id")).distinct()


def coverage(fields: DataFrame, offers: DataFrame) -> DataFrame:
    """``(source, n_covered, share)``: required ``fields(field)`` that each source of ``offers(source, field)`` has."""
    total = fields.agg(F.count_distinct("field").alias("total"))
    hit = offers.join(fields.select("field").distinct(), "field", "left_semi").distinct().groupBy("source").agg(F.count("*").alias("n"))
    return offers.select("source").distinct().join(hit, "source", "left").crossJoin(total).select("source", F.coalesce("n", F.lit(0)).alias("n_covered"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))


def rarity_score(fields: DataFrame, offers: DataFrame) -> DataFrame:
    """``(source, score)``: sum over a source's required fields of one over the number of sources that have it."""
    wanted = offers.join(fields.select("field").distinct(), "field", "left_semi").select("source", "field").distinct()
    weight = wanted.groupBy("field").agg((1 / F.count("*")).alias("w"))
    return wanted.join(weight, "field").groupBy("source").agg(F.round(F.sum("w"), 6).alias("score"))


def greedy_cover(fields: DataFrame, offers: DataFrame, most: int = 3) -> DataFrame:
    """``(step, source, gain)``: up to ``most`` sources, each with the largest number of fields not yet covered, ties by name."""
    spark = fields.sparkSession
    left = fields.select("field").distinct()
    rows: list[tuple[int, str, int]] = []
    for step in range(1, most + 1):  # as many rounds as sources are wanted; each is one aggregate
        best = offers.select("source", "field").distinct().join(left, "field", "left_semi").groupBy("source").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "source").first()
        if best is None:
            break
        rows.append((step, best["source"], best["gain"]))
        left = left.join(offers.filter(F.col("source") == best["source"]).select("field"), "field", "left_anti")
    return spark.createDataFrame(rows, "step long, source string, gain long")
