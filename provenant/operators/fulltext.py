"""Full-text search over an inverted index, by queries with alternatives, exclusions and phrases.

The index has a row for each word of a chunk: version_id, lexeme, chunk_id and the word's positions.  A query is a tree of two
levels, as search boxes have no parentheses: alternatives, each a list of terms that must all hold; a term is a run of adjacent
words that must occur, or, if negated, must not.  Queries meet the index by their words and never see a text.

Parsing follows ``websearch_to_tsquery``: words are joined by and, ``or`` stands between operands only, binds weaker than and, and is a
word where an operand is due; a minus before an operand excludes it, quotes make a phrase (to the end if they are not closed),
and so do words joined by punctuation; operands without a word fall away.  A query of which some alternative has nothing but exclusions is not
served by an index and finds nothing, as in ``querytree``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import has_cjk
from . import trigrams
from .retrieval import answered, asked_once, best, keyword_lexemes, tokens

TERM = "struct<words: array<string>, negated: boolean>"
TREE = f"array<array<{TERM}>>"
#: Up to so many different words of queries are broadcast to the index; beyond, both are shuffled by version and word.
BROADCAST_TERMS = 20_000


# -- queries --------------------------------------------------------------------------------------


def parse(query: Column | str) -> Column:
    """The tree of a search-box query; empty without operands."""
    text = F.regexp_replace(F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")), r"(^|\s)(-+)\s+", "$1$2")
    pieces = F.regexp_extract_all(text, F.lit(r'-*"[^"]*"?|[^\s"]+'), F.lit(0))
    body = lambda p: F.regexp_replace(p, "^-+", "")
    minus = lambda p: (F.length(p) - F.length(body(p))) % 2 == 1
    told = F.transform(pieces, lambda p, i: F.struct((F.lower(p) == "or").alias("word_or"), (i == F.size(pieces) - 1).alias("last"), F.struct(tokens(body(p)).alias("words"), minus(p).alias("negated")).alias("term")))
    # the alternatives before, the terms of this one, and whether an operand is due
    start = F.expr(f"struct(CAST(array() AS {TREE}) AS done, CAST(array() AS array<{TERM}>) AS now, true AS due)")
    is_or = lambda a, p: p["word_or"] & ~a["due"] & ~p["last"]

    def step(a: Column, p: Column) -> Column:
        after = F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), F.expr(f"CAST(array() AS array<{TERM}>)").alias("now"), F.lit(True).alias("due"))
        return F.when(is_or(a, p), after).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(p["term"])).alias("now"), F.lit(False).alias("due")))

    whole = F.aggregate(told, start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    return tidy(whole)


def tidy(tree: Column) -> Column:
    """The tree without terms that have no word and without alternatives that have no term."""
    return F.filter(F.transform(tree, lambda terms: F.filter(terms, lambda x: F.size(x["words"]) > 0)), lambda terms: F.size(terms) > 0)


def of_keywords(keywords: Column | str, any_keyword: bool = True) -> Column:
    """The tree of a keyword list: each keyword's words must all occur, of any keyword or of all."""
    each = F.transform(keywords, lambda k: F.transform(keyword_lexemes(k), lambda w: F.struct(F.array(w).alias("words"), F.lit(False).alias("negated"))))
    return tidy(each if any_keyword else F.array(F.flatten(each)))


def indexable(tree: Column | str) -> Column:
    """Whether every alternative has something that must occur, and there is one."""
    return (F.size(tree) > 0) & F.forall(tree, lambda terms: F.exists(terms, lambda x: ~x["negated"]))


# -- the index ------------------------------------------------------------------------------------


def postings(chunks: DataFrame) -> DataFrame:
    """version_id, lexeme, chunk_id and positions (from 0, ascending) of every word of every chunk; each chunk_id stands for one chunk.

    No exchange: a chunk's words are gathered in its own row, in Arrow batches.
    """

    def gathered(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = words.flatten().dictionary_encode()
        code = named.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * max(1, len(named.dictionary)) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
        lexemes = named.dictionary.take(pa.array(code[order][first]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[order][first], minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([lexemes, positions], ["lexeme", "positions"]))

    gathered.__annotations__ = {"words": pa.Array, "return": pa.Array}
    each = chunks.select("version_id", "chunk_id", F.arrow_udf(gathered, "array<struct<lexeme: string, positions: array<int>>>")(tokens("text_raw")).alias("own"))
    return each.select("version_id", "chunk_id", F.explode("own").alias("x")).select("version_id", "x.lexeme", "chunk_id", "x.positions")


def holds(tree: Column | str, held: Column | str) -> Column:
    """Whether a tree holds for a chunk whose words and positions are the map ``held``."""
    held = F.col(held) if isinstance(held, str) else held
    of = lambda w: F.coalesce(F.element_at(held, w), F.array().cast("array<int>"))

    def occurs(words: Column) -> Column:
        first = of(F.get(words, F.lit(0)))
        return F.exists(first, lambda p: F.forall(F.transform(words, lambda w, i: F.array_contains(of(w), (p + i).cast("int"))), lambda x: x))

    return F.exists(tree, lambda terms: F.forall(terms, lambda x: occurs(x["words"]) != x["negated"]))


def density(tree: list[list[tuple[list[str], bool]]], held: dict[str, list[int]]) -> float:
    """The cover-density weight of a chunk: each smallest stretch of the query's words in which the tree holds adds 0.1 by one more than the other words between."""
    at = sorted((p, w) for w, places in held.items() for p in places)

    def holds_in(seen: dict[str, set[int]]) -> bool:
        occurs = lambda words: any(all(p + i in seen.get(w, ()) for i, w in enumerate(words)) for p in seen.get(words[0], ()))
        return any(all(occurs(words) != negated for words, negated in terms) for terms in tree)

    def grow(places) -> int | None:
        seen: dict[str, set[int]] = {}
        for k in places:
            seen.setdefault(at[k][1], set()).add(at[k][0])
            if holds_in(seen):
                return k
        return None

    total, begin = 0.0, 0
    while begin < len(at):
        end = grow(range(begin, len(at)))
        if end is None:
            break
        first = grow(range(end, begin - 1, -1))
        if first is None:  # an excluded word on the way: the stretch holds from its front only
            begin += 1
            continue
        total += 0.1 / (1 + (at[end][0] - at[first][0]) - (end - first))
        begin = first + 1
    return total


def search(index: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, chunk_id, score (w / (w + 1) of the cover density w) and rank0 of the best 2 * top_k chunks of each query.

    ``queries``: query_id, version_id and tree.  A job counts the queries' different words while the plan is made.
    """
    asked, asking = asked_once(queries.where(indexable("tree")), "tree")
    words = F.array_distinct(F.flatten(F.transform(F.flatten("tree"), lambda x: x["words"])))
    wanted = asked.select("query_id", "version_id", F.explode(words).alias("lexeme"))
    listed = wanted.groupBy("version_id", "lexeme").agg(F.collect_set("query_id").alias("asking"))
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        listed = F.broadcast(listed)
    met = index.join(listed, ["version_id", "lexeme"]).select(F.explode("asking").alias("query_id"), "chunk_id", F.struct("lexeme", "positions").alias("found"))
    held = met.groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.collect_list("found")).alias("held"))
    single = F.forall("tree", lambda terms: (F.size(terms) == 1) & F.forall(terms, lambda x: (F.size(x["words"]) == 1) & ~x["negated"]))
    both = held.join(asked.select("query_id", "tree", single.alias("single")), "query_id").where(holds("tree", "held"))

    def weigh(trees: pa.Array, helds: pa.Array) -> pa.Array:
        pairs = zip(trees.to_pylist(), helds.to_pylist(), strict=True)
        return pa.array([None if t is None else density([[(x["words"], x["negated"]) for x in terms] for terms in t], dict(h)) for t, h in pairs], pa.float64())

    weigh.__annotations__ = {"trees": pa.Array, "helds": pa.Array, "return": pa.Array}
    covers = F.arrow_udf(weigh, "double")
    # of single words each occurrence is a cover; others are weighed in Arrow batches
    times = F.aggregate(F.map_values("held"), F.lit(0), lambda n, p: n + F.size(p))
    weighed = both.withColumn("w", F.when(F.col("single"), 0.1 * times).otherwise(covers(F.when(~F.col("single"), F.col("tree")), F.col("held"))))
    return answered(best(weighed.select("query_id", "chunk_id", (F.col("w") / (F.col("w") + 1)).alias("score")), top_k), asking)


def keyword_search(index: DataFrame, grams: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int, any_keyword: bool = True) -> DataFrame:
    """The rows of ``retrieval.keyword_search`` from indexes: full text, and by substring for queries with a CJK keyword and for those whose full-text search is empty.

    ``index``: ``postings`` and ``grams``: ``trigrams.index`` of the chunks, whose texts only verify candidates of the second.
    """
    cleaned = queries.withColumn("keywords", F.filter(F.transform("keywords", lambda k: F.trim(F.translate(k, '"', " "))), lambda k: k != ""))
    words = cleaned.where(~F.exists("keywords", has_cjk)).withColumn("tree", of_keywords("keywords", any_keyword))
    full = cut(search(index, words, top_k))  # 2 * top_k rows a query, read twice
    rest = cleaned.join(full.select("query_id").distinct(), "query_id", "left_anti")
    return full.unionByName(trigrams.substring_search(grams, chunks, rest, top_k))
