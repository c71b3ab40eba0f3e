"""Line dedup with a log-template tree.  DataFrame operations only.

Lines are parsed by a tree of fixed depth: the first level is the number of
tokens, the next ``DEPTH`` levels are the leading tokens, with any token that
holds a digit generalised to ``<*>``.  The lines of a leaf are parted into
groups.  A group's template holds at each position the token that more than
half of its lines have there, or ``<*>`` if none has; lines that agree with at
least ``SIMILAR`` of the positions are taken by it.  Those left over are parted
by the most common of their tokens that stand in at most half of them, and each
part votes again, until none is left.  Every template of a leaf, and every line
that none has taken, then draws all lines of the leaf that agree with it, so a
family parted by chance is whole again.  Templates recur from ``min_docs``
documents on, those of more than ``LONG_TOKENS`` tokens from ``long_docs`` on;
the lines they draw are dropped.

Only distinct generalised lines of leaves that several documents reach are
taken apart, each with the number of its lines, so a line that most documents
hold is one row of that step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import SPACES, WORD, free_name, materialize, plain_text

DEPTH, MIN_DOCS, SIMILAR = 4, 8, 0.6
#: A line of more tokens is a passage: it is no chance that it stands in two documents.
LONG_TOKENS, LONG_DOCS = 20, 2
ANY = "<*>"
#: Leaves of at most so many lines compare each line with each template.
FEW = 64
#: Broadcast hash buckets that tell which rows can't be in a join; at most so many numbers are ever sent.
BUCKETS = 2 ** 20
#: A template is hot with more than 1 / HOT of all lines; there are fewer than HOT such.
HOT = 1024


def generalised(line: Column) -> Column:
    """The line with every token that holds a digit as ``<*>``."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(
        line, r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9])[^\x20\x09-\x0D]+", ANY)).otherwise(line)


def token_count(line: Column) -> Column:
    """Number of tokens; where single spaces part them, as nearly everywhere, by counting those."""
    odd = line.rlike(r"[\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    single = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(single)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, line_no, tokens, general, leaf) of the lines that hold a token."""
    # the text is hashed before the lines are parted: beside them it would be hashed once a line
    texts = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    lines = texts.select("id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lead = F.regexp_extract("general", rf"^{SPACES[:-1]}*({WORD}(?:{SPACES}{WORD}){{0,{DEPTH - 1}}})", 1)
    return (lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("tokens", token_count(F.col("line")))
            .withColumn("general", generalised(F.col("line")))
            .withColumn("leaf", F.xxhash64("tokens", lead)))


def needed_docs(min_docs: int, long_docs: int) -> Column:
    """Documents from which on a line of ``tokens`` tokens recurs."""
    return F.when(F.col("tokens") > LONG_TOKENS, min(min_docs, long_docs)).otherwise(min_docs)


def narrowed(rows: DataFrame, keys: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """The rows that may have a partner in ``keys``, or with ``left_anti`` those that have none for sure.

    The buckets that ``keys`` reaches are broadcast, at most ``BUCKETS``
    integers, so rows beyond them need no shuffle.  Semi-joins, as a join that
    follows would be moved below any other."""
    name = free_name(rows, "__bucket")
    bucket = F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")
    return rows.join(F.broadcast(keys.select(bucket.alias(name)).distinct()), bucket == F.col(name), how)


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(leaf, line, n): hashes of the generalised lines whose template recurs, and the number of lines.

    ``lines``: id, leaf, line (hash of the generalised line), general, tokens."""
    holders = lines.groupBy("leaf", "line", "id").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens"))
    counts = materialize(holders.groupBy("leaf", "line").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.first("tokens").alias("tokens"))
        .withColumn("needed", needed_docs(min_docs, long_docs)))
    # leaves in which several lines may meet in a template; a line that recurs by itself needs no generalising
    shared = (counts.groupBy("leaf").agg(F.sum("docs").alias("reach"), F.count(F.lit(1)).alias("kinds"),
                                         F.min("docs").alias("least"), F.first("needed").alias("needed"))
              .filter("kinds > 1 and reach >= needed and least < needed").select("leaf"))
    open_counts = materialize(counts.join(shared, "leaf"))
    bodies = (narrowed(lines.select("leaf", "line", "general"), open_counts, ["leaf", "line"])
              .groupBy("leaf", "line").agg(F.min("general").alias("general"))
              .select("leaf", "line", F.regexp_extract_all("general", F.lit(WORD), F.lit(0)).alias("body")))
    bodies = materialize(bodies.join(open_counts, ["leaf", "line"]))
    drawn = materialize(drawn_lines(bodies, leaf_templates(bodies)))
    # a template with a line that recurs by itself recurs; the others' lines are held by few documents each
    sums = drawn.groupBy("leaf", "template").agg(F.max(F.col("docs") >= F.col("needed")).alias("sure"),
                                                 F.sum("docs").alias("reach"), F.first("needed").alias("needed"))
    open_templates = sums.filter("not sure and reach >= needed").select("leaf", "template")
    open_lines = materialize(drawn.join(open_templates, ["leaf", "template"]).select("leaf", "line", "template", "needed"))
    together = (narrowed(lines.select("leaf", "line", "id"), open_lines, ["leaf", "line"])
                .join(open_lines, ["leaf", "line"])
                .groupBy("leaf", "template", "id").agg(F.first("needed").alias("needed"))
                .groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.first("needed").alias("needed"))
                .filter("docs >= needed"))
    found = sums.filter("sure").select("leaf", "template").unionByName(together.select("leaf", "template"))
    alone = counts.filter("docs >= needed").select("leaf", "line", "n")
    return alone.unionByName(drawn.join(found, ["leaf", "template"], "left_semi").select("leaf", "line", "n")).distinct()


def leaf_templates(bodies: DataFrame) -> DataFrame:
    """(leaf, template, kept) of every leaf: ``kept`` is an array of (pos, word).

    ``bodies``: leaf, line, n, tokens, body (the tokens of the line).  Each
    round lets every part of a leaf vote and parts the lines left over by the
    most common of their tokens that at most half of them hold, so a part halves
    at least: the rounds follow the logarithm of a leaf's lines."""
    whole = F.transform("body", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    left = bodies.select("leaf", F.col("leaf").alias("part"), "line", "n", "tokens", "body")
    done, rounds = [], 0
    while True:
        votes = (left.select("part", "n", F.posexplode("body").alias("pos", "word"))
                 .groupBy("part", "pos", "word").agg(F.sum("n").alias("votes")))
        kept = materialize(
            votes.groupBy("part", "pos").agg(F.max(F.struct("votes", "word")).alias("best"), F.sum("votes").alias("all"))
            .filter(F.col("best.votes") * 2 > F.col("all"))
            .groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("best.word").alias("word")))).alias("kept")))
        voted = materialize(left.join(kept, "part", "left").withColumn(
            "taken", F.coalesce(agreeing("kept") >= F.col("tokens") * SIMILAR, F.lit(False))).drop("kept"))
        winners = voted.filter("taken").select("leaf", "part").distinct()
        done.append(kept.join(winners, "part").select("leaf", F.xxhash64("part", F.lit(rounds)).alias("template"), "kept"))
        rest = voted.filter("not taken")
        sizes = rest.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        rest = materialize(rest.join(sizes, "part").drop("taken"))
        done.append(rest.filter("size <= 2").select("leaf", F.xxhash64("line", F.lit("alone")).alias("template"),
                                                    whole.alias("kept")))
        rest = rest.filter("size > 2")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        words = rest.select("part", "line", "size", F.posexplode("body").alias("pos", "word"))
        common = (words.groupBy("part", "pos", "word").agg(F.count(F.lit(1)).alias("lines"), F.first("size").alias("size"))
                  .filter("lines * 2 <= size").drop("size"))
        pivots = (words.drop("size").join(common, ["part", "pos", "word"]).groupBy("part", "line")
                  .agg(F.max(F.struct("lines", "pos", "word")).alias("pivot")))
        left = materialize(rest.join(pivots, ["part", "line"], "left").select(
            "leaf", F.xxhash64("part", "pivot.pos", "pivot.word").alias("part"), "line", "n", "tokens", "body"))
        rounds += 1


def agreeing(kept: str) -> Column:
    """Number of positions at which ``body`` has the template's token."""
    return F.size(F.filter(kept, lambda k: F.get(F.col("body"), k["pos"]) == k["word"]))


def drawn_lines(bodies: DataFrame, templates: DataFrame) -> DataFrame:
    """(leaf, line, template, n, docs, needed): the lines that agree with each
    template of their leaf in at least ``SIMILAR`` of the positions.

    Leaves of at most ``FEW`` lines compare all.  In larger ones, a line that
    agrees holds one of any k - m + 1 of a template's k tokens, m being the least
    number that must agree; the rarest in the leaf find the candidates."""
    sizes = materialize(bodies.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"),
                                                   F.ceil(F.first("tokens") * SIMILAR).cast("int").alias("least")))
    few = sizes.filter(F.col("kinds") <= FEW).select("leaf")
    many = sizes.filter(F.col("kinds") > FEW).select("leaf", "least")
    words = bodies.join(many, "leaf", "left_semi").select("leaf", "line", F.posexplode("body").alias("pos", "word"))
    votes = words.groupBy("leaf", "pos", "word").agg(F.count(F.lit(1)).alias("lines"))
    rarest = (templates.join(many, "leaf").select("leaf", "template", "least", F.explode("kept").alias("k"))
              .select("leaf", "template", "least", "k.pos", "k.word").join(votes, ["leaf", "pos", "word"])
              .groupBy("leaf", "template").agg(F.array_sort(F.collect_list(F.struct("lines", "pos", "word"))).alias("all"),
                                               F.first("least").alias("least")))
    probes = rarest.select("leaf", "template", F.explode(F.slice(
        "all", 1, F.greatest(F.size("all") - F.col("least") + 1, F.lit(0)))).alias("p")).select(
        "leaf", "template", "p.pos", "p.word")
    pairs = words.join(probes, ["leaf", "pos", "word"]).select("leaf", "line", "template").distinct()
    compared = (bodies.join(few, "leaf", "left_semi").join(templates, "leaf")
                .unionByName(pairs.join(templates, ["leaf", "template"]).join(bodies, ["leaf", "line"])))
    return (compared.filter(agreeing("kept") >= F.col("tokens") * SIMILAR)
            .select("leaf", "line", "template", "n", "docs", "needed"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id",
                         text_col: str = "text", long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` without the lines of recurring templates, and
    two more columns: n_lines and n_dropped.

    Lines end with a line feed.  Lines without a token never recur and stay.
    A null text stays null, with no lines; an empty text has one line and stays
    empty.  A template recurs by the number of distinct ids that hold it, so
    repeated rows count once; null ids count as one.  An empty table stays
    empty; other columns are kept (columns named n_lines or n_dropped are
    replaced)."""
    ident, of, drop, version, split = (free_name(docs, f"__{x}") for x in ("id", "of", "drop", "version", "parts"))
    lines = materialize(line_table(docs, id_col, text_col).select(
        "id", "version", "line_no", "tokens", "leaf", "general", F.xxhash64("general").alias("line")))
    recurring = materialize(recurring_lines(lines, min_docs, long_docs))
    n_lines = lines.count()
    # a hot line is broadcast, so its holders don't meet in one task; there are fewer than HOT of them
    is_hot = F.col("n") * HOT > n_lines
    hot, others = (recurring.filter(x).select("leaf", "line") for x in (is_hot, ~is_hot))
    place = lines.select("id", "version", "line_no", "leaf", "line")
    dropped = materialize(place.join(F.broadcast(hot), ["leaf", "line"], "left_semi")
                          .unionByName(narrowed(place, others, ["leaf", "line"]).join(others, ["leaf", "line"], "left_semi"))
                          .groupBy("id", "version").agg(F.collect_set("line_no").alias(drop))
                          .withColumnsRenamed({"id": ident, "version": of}))
    keyed = docs.withColumn(version, F.xxhash64(plain_text(text_col)))
    # texts whose bucket has no dropped line go through unmoved
    keys, places = [id_col, version], dropped.select(F.col(ident).alias(id_col), F.col(of).alias(version))
    moved = narrowed(keyed, places, keys)
    joined = (moved.join(dropped, moved[id_col].eqNullSafe(dropped[ident]) & (moved[version] == dropped[of]), "left")
              .select(*keyed.columns, drop)
              .unionByName(narrowed(keyed, places, keys, "left_anti").withColumn(drop, F.lit(None).cast("array<int>")))
              .withColumn(split, F.split(text_col, "\n")))
    parts = F.col(split)  # a column, so that a text is parted once, not once a line
    # a difference of sets of line numbers: linear in the lines, also where nearly all of them go
    staying = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
    kept = F.array_join(F.transform(staying, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *[F.when(F.col(drop).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c)
          for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"))
