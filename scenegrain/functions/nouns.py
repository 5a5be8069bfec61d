"""Nouns of captions: a lexicon of (word, tag), suffix rules for words it doesn't know, and singular forms."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.functions.scalar import NO_LABEL, after_marker
from scenegrain.operators.names import free_names

#: English words of closed classes by tag, and plurals that no rule gives.
CLOSED = {
    "DT": "a an the this that these those some any no every each all both",
    "IN": "of in on at by for with from to into over under between behind near about as if than beside above below",
    "PRP": "i you he she it we they me him her us them its his their our my your who what which there here",
    "CC": "and or but nor so yet not then also very",
    "VB": "is are was were be been being am has have had do does did can could will would may might must shall should",
    "JJ": "white black red green blue brown small large big other many few several more most old new",
}
IRREGULAR = {
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse",
    "knives": "knife", "shelves": "shelf", "leaves": "leaf", "loaves": "loaf", "scarves": "scarf", "wolves": "wolf",
}
#: Tag by the end of an unknown word, the first that fits; NN if none does.
SUFFIXES = (
    ("RB", "..ly$"),
    ("VB", "..(ing|ed)$"),
    ("JJ", "..(able|ible|ful|ous|ish|less|est)$"),
    ("CD", "^[0-9]"),
    ("NN", "(ss|us|is)$"),
    ("NNS", "..s$"),
)
#: Singular by the end of a plural: the first rule that fits.
SINGULAR = (("...ies$", "ies$", "y"), ("(s|x|z|ch|sh)es$", "es$", ""), ("(ss|us|is)$", "$", ""), ("..s$", "s$", ""))


def closed_words(spark: SparkSession) -> DataFrame:
    """The built-in lexicon: word, tag, singular (null where the rules hold)."""
    rows = [(w, t, None) for t, words in CLOSED.items() for w in words.split()] + [(p, "NNS", s) for p, s in IRREGULAR.items()]
    return spark.createDataFrame(rows, "word string, tag string, singular string")


def guessed_tag(word: Column) -> Column:
    out = F.lit("NN")
    for tag, end in reversed(SUFFIXES):
        out = F.when(word.rlike(end), tag).otherwise(out)
    return out


def singular(word: Column) -> Column:
    """The singular of a regular English plural; a word that isn't one stays."""
    out = word
    for fits, end, instead in reversed(SINGULAR):
        out = F.when(word.rlike(fits), F.regexp_replace(word, end, instead)).otherwise(out)
    return out


def tagged_words(texts: DataFrame, text_col: str, lexicon: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """All columns but the text, and place, word, tag, noun for each word behind the last marker, in lower case.

    Words are runs of letters and digits. `lexicon` has word, tag and singular, a row a word, and replaces the built-in one;
    it is broadcast up to `most` words, else joined by the word. noun is the singular of words whose tag starts with N, else
    null. Null and empty texts have no rows; repeated rows are kept; long texts are read whole.
    """
    place, word, tag, noun = free_names(texts.drop(text_col), "place", "word", "tag", "noun")
    lexicon = closed_words(texts.sparkSession) if lexicon is None else lexicon
    lex = lexicon.select(F.col("word").alias("_w"), F.col("tag").alias("_t"), F.col("singular").alias("_s"))
    lex = lex.select(F.struct("_w", "_t", "_s").alias("_lex"))
    small = lexicon.limit(most + 1).count() <= most
    words = F.regexp_extract_all(after_marker(F.col(text_col)), F.lit(r"[\p{L}0-9]+"), F.lit(0))
    w = texts.select(*(c for c in texts.columns if c != text_col), F.posexplode(words).alias(place, word))
    w = w.join(F.broadcast(lex) if small else lex, w[word] == lex["_lex._w"], "left")
    w = w.withColumn(tag, F.coalesce("_lex._t", guessed_tag(F.col(word))))
    one = F.coalesce("_lex._s", F.when(F.col(tag).isin("NNS", "NNPS"), singular(F.col(word))).otherwise(F.col(word)))
    return w.withColumn(noun, F.when(F.col(tag).startswith("N"), one)).drop("_lex")


def noun_phrases(texts: DataFrame, text_col: str, *keys: str, lexicon: DataFrame | None = None) -> DataFrame:
    """keys, labels: the nouns of each text in order, behind the label that every scene has. A row for each text: keys must
    tell texts apart; null and empty texts have that label alone."""
    own = [f"_key{i}" for i in range(len(keys))]
    named = texts.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(text_col).alias("_text"))
    w = tagged_words(named, "_text", lexicon).where("noun IS NOT NULL")
    in_order = F.array_sort(F.collect_list(F.struct("place", "noun")))
    n = w.groupBy(*own).agg(F.transform(in_order, lambda x: x["noun"]).alias("labels")).select(F.struct(*own, "labels").alias("_n"))
    on = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_n.{o}")) for k, o in zip(keys, own)))
    labels = F.concat(F.array(F.lit(NO_LABEL)), F.coalesce("_n.labels", F.array().cast("array<string>")))
    return texts.select(*keys).join(n, on, "left").select(*keys, labels.alias("labels"))
