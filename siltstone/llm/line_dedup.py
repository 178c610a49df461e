"""Line deduplication with a log-template tree, with DataFrame functions alone.

Every line is parsed by a tree of fixed depth: its number of tokens, then its DEPTH
leading tokens; tokens with a digit are variable fields (``<*>``) from the start.  A
leaf holds all lines that share this path.  Where a leaf has several patterns, a
position whose commonest token has fewer than half of them (each counted in as many documents
as it stands in) generalises to ``<*>``; a pattern that agrees with at least SIMILAR of all positions
of this template belongs to it.  The others are divided by their token at the position with
the fewest different ones, those whose token there is too rare to recur staying together, and each part has a template of its own,
until nothing in it can recur: a leaf has as many templates as it has families of lines.  What no template takes stands for itself.

A template that occurs in at least MIN_DOCS documents is recurring.  Its first
occurrence (smallest doc_id, then line number) stays, the others are dropped.  Lines with fewer than
MIN_TOKENS tokens are too short for a template; with ``short`` they recur as they are, digits included, else they stay.

Only hashes, ids and line numbers of lines are shuffled, plus the patterns of leaves with more
than one; a line that fills a third of the corpus is dealt over many tasks.

Edge cases: a null text stays null and an empty one empty; blank lines stay; rows
alike in id and text are one document and keep the same lines; a null doc_id sorts first; an
empty table gives an empty result; ties in a position go to the larger token; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, scratch, settled, skew_lookup, stored

DEPTH = 3
MIN_TOKENS = 4
MIN_DOCS = 3
SIMILAR = 0.7
FIELD = "<*>"
# Linear: it starts at a token's start and never goes back.
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def folded_of(line: Column) -> Column:
    """Tokens joined by one space."""
    # Plain searches first: most lines need no regular expression.
    uneven = F.contains(line, F.lit("  "))
    for space in "\t\r\f\x0b":
        uneven = uneven | F.contains(line, F.lit(space))
    return F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")).otherwise(line))


def pattern_of(line: Column) -> Column:
    """Tokens joined by one space, those with a digit as FIELD."""
    folded = folded_of(line)
    return F.when(folded.rlike("[0-9]"), F.regexp_replace(folded, _VARIABLE, FIELD)).otherwise(folded)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_tokens: int, short: bool = False) -> DataFrame:
    """doc, doc_id, line, pattern, tokens, leaf of every line long enough for a template, and with short of all shorter ones but blanks."""
    # The key first, in a step of its own: beside the generator it would be computed for every line.
    rows = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("doc"), F.col(id_col).alias("doc_id"), F.split(text_col, "\n").alias("raw"))
    # Tokens are counted in bytes, once, inside the generator; a filter above it would count them again.
    blanks = lambda p: F.octet_length(p) - F.octet_length(F.replace(p, F.lit(" "), F.lit("")))
    parsed = F.transform(F.transform("raw", pattern_of), lambda p: F.struct(p.alias("pattern"), (blanks(p) + 1).alias("tokens")))
    if short:
        # A short line's pattern is the line itself; its leaf then holds no other.
        parsed = F.zip_with(parsed, "raw", lambda p, x: F.struct(F.when(p["tokens"] < min_tokens, folded_of(x)).otherwise(p["pattern"]).alias("pattern"), p["tokens"].alias("tokens")))
    rows = rows.select("doc", "doc_id", F.posexplode(parsed).alias("line", "p")).select("doc", "doc_id", "line", "p.pattern", "p.tokens")
    leaf = F.xxhash64("tokens", F.substring_index("pattern", " ", DEPTH))
    if short:
        leaf = F.when(F.col("tokens") < min_tokens, F.xxhash64("tokens", "pattern")).otherwise(leaf)
    wanted = F.col("pattern") != "" if short else F.col("tokens") >= min_tokens
    return rows.where(wanted).withColumn("leaf", leaf)


def _families(texts: DataFrame, min_docs: int, similar: float) -> DataFrame:
    """(shape, template) of every pattern that a template takes; texts: shape, node (the leaf), tokens (an array), docs.

    One round gives every node its template and divides what is left.  A part is always smaller than its
    node, and a node without a token that min_docs documents share and others lack is not divided, so the rounds end.
    """
    spark, taken, live = texts.sparkSession, [], texts
    while True:
        sizes = live.groupBy("node").agg(F.sum("docs").alias("node_docs"), F.count("*").alias("w")).where((F.col("node_docs") >= min_docs) & (F.col("w") > 1))
        each = live.select("node", "docs", F.posexplode("tokens").alias("at", "token"))
        counted = stored(each.groupBy("node", "at", "token").agg(F.sum("docs").alias("docs"), F.count("*").alias("w")), "node-tokens")
        # Commonest token of each position; ties go to the larger token.
        top = counted.groupBy("node", "at").agg(F.max(F.struct("docs", "token")).alias("top"), F.count("*").alias("kinds")).join(sizes, "node")
        constant = F.when(F.col("top.docs") * 2 >= F.col("node_docs"), F.col("top.token"))
        dividing = F.when((F.col("kinds") > 1) & (F.col("top.docs") >= min_docs), F.struct("kinds", "at"))
        nodes = top.select("node", "w", "at", constant.alias("token"), dividing.alias("dividing")).groupBy("node", "w")
        nodes = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"), F.min("dividing")["at"].alias("split"))
        nodes = stored(nodes, "node-templates")
        agree = F.size(F.filter(F.zip_with("template", "tokens", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        held = skew_lookup(live, nodes, "node", "w", F.xxhash64("shape")).where("template is not null")
        held = stored(held.withColumn("general", agree >= F.size("tokens") * F.lit(similar)).drop("template"), "node-patterns")
        taken.append(held.where("general").select("shape", F.hex(F.xxhash64("node", F.size("tokens"))).alias("template")))
        left = held.where("not general and split is not null")
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, taken)
        part = F.xxhash64("node", "split", F.element_at("tokens", F.col("split") + 1))
        shared = counted.where(F.col("docs") >= min_docs).join(nodes.select("node", F.col("split").alias("at")), ["node", "at"])
        shared = stored(shared.select(F.xxhash64("node", "at", "token").alias("part"), F.lit(True).alias("shared"), "w"), "node-parts")
        left = skew_lookup(left.withColumn("part", part), shared, "part", "w", F.xxhash64("shape"))
        left = left.select("shape", F.when(F.col("shared"), F.col("part")).otherwise(F.xxhash64("node", "split")).alias("node"), "tokens", "docs")
        live = stored(left, "node-rest")


def templates(patterned: DataFrame, index: DataFrame, min_docs: int, similar: float) -> DataFrame:
    """(shape, n, first_doc, first_line) of every pattern of a recurring template: its hash, its lines, the template's first occurrence; patterned: leaf, shape, pattern."""
    by_doc = index.groupBy("leaf", "shape", "doc").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc", "line")).alias("first"))
    patterns = stored(by_doc.groupBy("leaf", "shape").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min("first").alias("first")), "line-patterns")
    several = patterns.groupBy("leaf").agg(F.count("*").alias("patterns"), F.sum("docs").alias("docs")).where((F.col("patterns") > 1) & (F.col("docs") >= min_docs)).select("leaf")

    wanted = patterns.join(several, "leaf", "left_semi").select("shape", "docs")
    texts = patterned.select("pattern", "leaf", "shape").join(several, "leaf", "left_semi")
    texts = texts.groupBy("shape").agg(F.first("pattern").alias("pattern"), F.first("leaf").alias("leaf"))
    texts = stored(texts.join(wanted, "shape").select("shape", F.col("leaf").alias("node"), F.split("pattern", " ").alias("tokens"), "docs"), "pattern-texts")
    general = _families(texts, min_docs, similar).withColumn("general", F.lit(True))

    grouped = patterns.join(general, "shape", "left")
    # Documents of a general template are counted once, whichever of its patterns they hold.
    merged = stored(grouped.where("general").select("shape", "template", "docs"), "general-patterns")
    held = skew_lookup(index.select("shape", "doc").distinct(), merged, "shape", "docs", F.xxhash64("doc")).where("template is not null")
    docs_of = held.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("template_docs"))
    alone = grouped.where("general is null and docs >= " + str(min_docs)).select("shape", "n", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))
    firsts = grouped.where("general").groupBy("template").agg(F.min("first").alias("template_first"), F.count("*").alias("w"))
    recurring = stored(firsts.join(docs_of.where(F.col("template_docs") >= min_docs).select("template"), "template", "left_semi").select("template", "w", F.col("template_first.doc").alias("first_doc"), F.col("template_first.line").alias("first_line")), "recurring-templates")
    # A template may have most of all patterns.
    shared = skew_lookup(grouped.where("general").drop("first"), recurring, "template", "w", F.xxhash64("shape")).where("first_doc is not null").select("shape", "n", "first_doc", "first_line")
    return alone.unionByName(shared)


def prefix_of(docs: DataFrame) -> str:
    """The prefix of the two added columns: ``_ld_``, or a longer one where docs has such names."""
    prefix = "_ld_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similar: float = SIMILAR, short: bool = False) -> DataFrame:
    """docs with recurring lines dropped from text, and lines and dropped (lines before, lines dropped) behind the prefix of prefix_of()."""
    prefix = prefix_of(docs)
    doc, drop = f"{prefix}doc", f"{prefix}drop"
    with scratch(docs.sparkSession):
        lines = _lines(docs, id_col, text_col, min_tokens, short)
        # With the patterns: texts are parsed once.
        patterned = stored(lines.select("doc", "doc_id", "line", "leaf", F.unhex(F.md5("pattern")).alias("shape"), "pattern"), "line-index")
        index = patterned.drop("pattern")
        # A leaf with fewer lines than a recurring template needs documents can hold none: most lines go here.
        busy = stored(index.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).withColumn("busy", F.lit(True)), "busy-leaves")
        index = stored(skew_lookup(index, busy, "leaf", "n", F.xxhash64("doc", "line")).where("busy").drop("busy"), "busy-lines")
        recurring = stored(templates(patterned, index, min_docs, similar), "line-templates")
        met = skew_lookup(index.select("doc", "line", "shape"), recurring, "shape", "n", F.xxhash64("doc", "line"))
        dropped = met.where(F.col("first_doc").isNotNull() & ~((F.col("doc") == F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
        dropped = settled(dropped.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(drop)), "dropped-lines")
    out = docs.withColumn(doc, row_key(id_col, text_col)).join(dropped, doc, "left")
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(drop, i))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    lines = F.when(F.col(text_col).isNotNull(), F.size(F.split(text_col, "\n"))).otherwise(0).cast("long")
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, lines.alias(f"{prefix}lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(f"{prefix}dropped"))
