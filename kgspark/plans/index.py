"""The whole index: documents to linked tables, stage by stage; and a feature job on top."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import config
from kgspark.augment import spec
from kgspark.context import reports, search
from kgspark.graph import communities, merge, tables
from kgspark.model import offline, prompts, records
from kgspark.model.apply import Chat, model_map
from kgspark.model.gleaning import extract_with_gleaning
from kgspark.model.summarize import summarize_lines
from kgspark.session import scratch_path, spread
from kgspark.sources.tables import stage
from kgspark.text import chunk
from kgspark.vector import embed


@dataclass
class Models:
    """Functions called on the executors; the offline ones stand in for a model."""

    extract: Chat | None = None
    summarize: Chat = offline.summarize
    report: object = None
    answer: Chat = offline.points
    embed: embed.Embed = offline.embed


def _report(texts, attempt):
    return offline.report(texts)


def build_index(
    spark: SparkSession,
    documents: DataFrame,
    root: str | None = None,
    models: Models | None = None,
    chunk_size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    report_tokens: int = config.REPORT_CONTEXT_TOKENS,
    with_reports: bool = True,
    with_vectors: bool = True,
    community_strategy: str = "modularity",
    gleanings: int = 0,
) -> dict[str, DataFrame]:
    """All stage tables by name. ``documents`` holds id, text, title.

    With ``gleanings``, ``models.extract`` takes (texts, round) and is asked
    again that often for what it missed.

    Every stage is written under ``root`` and read back; a second call with the
    same root picks up after the last finished stage.
    """
    models = models or Models()
    root = root or scratch_path(spark, "index")
    done: dict[str, DataFrame] = {}

    def add(name, compute, **options):
        done[name] = stage(spark, root, name, compute, **options)
        return done[name]

    docs = add("documents_in", lambda: documents.dropDuplicates(["id"]))
    units = add("base_text_units", lambda: chunk.text_units(spread(docs), chunk_size, overlap))

    def extracted():
        answers = (
            offline.answer_extraction(units, "chunk", ["id"])
            if models.extract is None
            else extract_with_gleaning(units, "id", "chunk", models.extract, gleanings)
            if gleanings
            else model_map(units, models.extract, "chunk", ["id"])
        )
        return records.parse_records(answers, "output", ["id"])

    found = add("extracted", extracted)
    entity = records.entities(found, ["id"])
    relation = records.relationships(found, ["id"])
    node_units = add("node_units", lambda: entity.select("title", F.col("id").alias("text_unit_id")).distinct())
    edge_units = add("edge_units", lambda: relation.select("source", "target", F.col("id").alias("text_unit_id")).distinct())

    def merged_nodes():
        kinds = merge.merge_nodes(entity.select("title", "type", "id", "record"), ["id", "record"], {"*": ("skip",)})
        text = summarize_lines(entity.select("title", "description"), "title", "description", models.summarize)
        nodes = kinds.join(text.withColumnRenamed("summary", "description"), "title", "left")
        return merge.with_missing_endpoints(nodes, relation.select("source", "target"))

    def merged_edges():
        sums = merge.merge_edges(relation.select("source", "target", "weight", "id", "record"), ["id", "record"])
        keyed = relation.select(F.concat_ws("\u0001", "source", "target").alias("edge"), "description")
        text = summarize_lines(keyed, "edge", "description", models.summarize)
        return (
            sums.withColumn("edge", F.concat_ws("\u0001", "source", "target"))
            .join(text.withColumnRenamed("summary", "description"), "edge", "left")
            .drop("edge")
        )

    nodes = add("summarized_nodes", merged_nodes)
    edges = add("summarized_edges", merged_edges)
    member = add("membership", lambda: communities.detect(edges, community_strategy), partition_by=("level",))
    final_nodes = add("nodes", lambda: tables.nodes_table(nodes, member, edges), partition_by=("level",))
    add("entities", lambda: tables.entities_table(nodes, node_units))
    relations = add("relationships", lambda: tables.relationships_table(edges, edge_units))
    add("communities", lambda: tables.communities_table(edges, edge_units, member), partition_by=("level",))
    unit_e = add("text_unit_entities", lambda: tables.unit_entities(node_units))
    unit_r = add("text_unit_relationships", lambda: tables.unit_relationships(edge_units))
    if with_reports:
        ranked = relations.filter("page = 0").select("human_readable_id", "source", "target", "description", "rank")
        add(
            "community_reports",
            lambda: reports.community_reports(final_nodes, ranked, models.report or _report, report_tokens),
            partition_by=("level",),
        )
        add("report_rejects", lambda: reports.report_rejects(final_nodes, done["community_reports"]))
    add("text_units", lambda: tables.final_text_units(units, unit_e, unit_r))
    add("documents", lambda: tables.final_documents(docs, units))
    if with_vectors:
        described = nodes.select(tables.entity_id(F.col("title")).alias("id"), F.concat_ws(":", "title", "description").alias("text"))
        add("entity_vectors", lambda: embed.text_embed(described, "id", "text", models.embed, "vector").filter("vector IS NOT NULL"))
    return done


def answer_questions(index: dict[str, DataFrame], questions: DataFrame, models: Models | None = None, level: int = config.COMMUNITY_LEVEL) -> DataFrame:
    """Global search over a built index."""
    models = models or Models()
    nodes = index["nodes"]
    scoped = search.reports_in_scope(index["community_reports"], nodes, level)
    links = nodes.filter(F.col("community").isNotNull()).select("title", "community").distinct().join(index["node_units"], "title")
    weights = search.community_weights(links.select("community", "text_unit_id"))
    chosen = search.select_reports(scoped.join(weights, "community", "left").withColumn("content", F.col("summary")))
    return search.global_search(questions, chosen, models.answer, models.summarize)


def feature_job(
    index: dict[str, DataFrame], topics: DataFrame, topic: str, templates: DataFrame, to_spec: Chat, models: Models | None = None
) -> DataFrame:
    """topic, feature, dtype: questions on all topics, their answers, features from the answers.

    ``templates`` holds question_no and template.
    """
    asked = prompts.questions(topics.select(topic).distinct(), topic, templates, "question_no", "template")
    keyed = asked.withColumn("question_id", F.concat_ws("#", F.col(topic), F.col("question_no").cast("string")))
    answers = answer_questions(index, keyed.select("question_id", "question"), models)
    told = prompts.prior_knowledge(answers.join(keyed.select("question_id", topic, "question_no"), "question_id"), topic, "question_no", "response")
    return spec.keyword_spec(model_map(told, to_spec, "prior_knowledge", [topic]), [topic], "output").distinct()


def embedder_info(spark: SparkSession, root: str) -> DataFrame:
    """source, model_name, size: who made the vectors of the index under ``root``; questions need the same."""
    return spark.read.parquet(f"{root.rstrip('/')}/embedder")


def build_vector_index(
    documents: DataFrame, key: str, text: str, fn: embed.Embed, root: str | None = None, embedder: tuple[str, str] | None = None
) -> DataFrame:
    """id, text, vector per character chunk of the documents, as a stage table.

    ``embedder`` (source, model name) is written next to the vectors, with their size.
    """
    spark = documents.sparkSession
    root = root or scratch_path(spark, "vectors")

    def chunks():
        parts = chunk.chunk_chars(documents, key, text)
        return parts.select(F.concat_ws("#", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("chunk").alias("text"))

    pieces = stage(spark, root, "chunks", chunks)
    vectors = lambda: pieces.join(embed.text_embed(pieces, "id", "text", fn, "vector"), "id").filter("vector IS NOT NULL")
    built = stage(spark, root, "vectors", vectors)
    if embedder is not None:
        size = built.agg(F.max(F.size("vector")).alias("size"))
        stage(spark, root, "embedder", lambda: size.select(F.lit(embedder[0]).alias("source"), F.lit(embedder[1]).alias("model_name"), "size"))
    return built


