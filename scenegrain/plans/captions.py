"""Queries on captions and files: nouns by a lexicon, points written as meshes and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenegrain.functions import nouns
from scenegrain.plans.registry import points, q
from scenegrain.sources import streams
from scenegrain.sources.formats import read_ply
from scenegrain.sources.tables import shared_dir, table


def tags_sql() -> str:
    """Common table expressions up to `tagged`: conv_id, turn, place, word, tag, noun."""
    lex = [f"('{w}', '{t}', NULL)" for t, words in nouns.CLOSED.items() for w in words.split()]
    lex += [f"('{p}', 'NNS', '{s}')" for p, s in nouns.IRREGULAR.items()]
    match = lambda e: f"regexp_matches(w.word, '{e}')"
    guess = "CASE " + " ".join(f"WHEN {match(e)} THEN '{t}'" for t, e in nouns.SUFFIXES) + " ELSE 'NN' END"
    one = "CASE " + " ".join(f"WHEN {match(f)} THEN regexp_replace(w.word, '{e}', '{i}')" for f, e, i in nouns.SINGULAR) + " ELSE w.word END"
    return (
        f"WITH lex(word, tag, singular) AS (VALUES {', '.join(lex)}), "
        r"l AS (SELECT conv_id, turn, regexp_extract_all(lower(string_split(text, '[/INST]')[-1]), '[\p{L}0-9]+') AS words FROM conversations), "
        "w AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM l), "
        f"t AS (SELECT w.*, coalesce(lex.tag, {guess}) AS tag, lex.singular, {one} AS one FROM w LEFT JOIN lex ON w.word = lex.word), "
        "tagged AS (SELECT conv_id, turn, place, word, tag, CASE WHEN tag LIKE 'N%' THEN "
        "coalesce(singular, CASE WHEN tag IN ('NNS', 'NNPS') THEN one ELSE word END) END AS noun FROM t) "
    )


@q("q_word_tags", tags_sql() + "SELECT tag, noun, count(*) AS n FROM tagged GROUP BY ALL")
def q_word_tags(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return nouns.tagged_words(c, "text").groupBy("tag", "noun").agg(F.count("*").alias("n"))


NOUNS = (
    "SELECT c.conv_id, c.turn, concat('floor', coalesce(',' || n.s, '')) AS labels FROM conversations c LEFT JOIN "
    "(SELECT conv_id, turn, string_agg(noun, ',' ORDER BY place) AS s FROM tagged WHERE noun IS NOT NULL GROUP BY conv_id, turn) n "
    "USING (conv_id, turn)"
)


@q("q_noun_phrases", tags_sql() + NOUNS)
def q_noun_phrases(spark, d):
    n = nouns.noun_phrases(table(spark, d, "conversations"), "text", "conv_id", "turn")
    return n.select("conv_id", "turn", F.array_join("labels", ",").alias("labels"))


@q("q_ply_files", "SELECT CAST(label AS VARCHAR) AS scene_id, count(*) AS n_points, round(sum(embedding[1]::DOUBLE), 3) AS x, round(max(embedding[2]::DOUBLE), 3) AS y, round(min(embedding[3]::DOUBLE), 3) AS z FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def q_ply_files(spark, d):
    """Every point is written into the mesh of its label, and all meshes are read again."""
    path = f"{shared_dir(spark)}/scenegrain/meshes-{uuid.uuid4().hex}"
    p = points(spark, d).where("label IS NOT NULL")
    streams.write_files(streams.ply_files(p, "spt_id", scene="label"), path, order="part")
    v, _ = read_ply(spark, path)
    g = v.groupBy(F.regexp_extract("path", r"([^/]+)\.ply$", 1).alias("scene_id"))
    return g.agg(F.count("*").alias("n_points"), F.round(F.sum("x"), 3).alias("x"), F.round(F.max("y"), 3).alias("y"), F.round(F.min("z"), 3).alias("z"))
