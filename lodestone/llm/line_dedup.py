"""Operator 1, line dedup [native]: winnowed line hashes find repeated runs, which are deleted where they occur later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A repeated run counts from so many words on.
RUN_WORDS = 50


def fingerprints(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``doc_id, th, s, fp, picked, ends``: a row per line that starts a window; ``th`` is the text's hash.

    A window is the shortest run of lines (blank ones aside) with ``run_words`` words from line ``s`` on. Its
    fingerprint ``fp`` is the least of its lines' hashes (the first of equal ones), so two equal windows have
    the same one. Neighbouring windows mostly share their minimum: ``picked`` marks the first window of each
    selected position, so the picked rows are the winnowed fingerprints of the text.

    ``ends`` holds ``(wh, e)``, the hash of lines s to e, for the window and for those longer runs from ``s``
    that have ``run_words`` words no more without their first line: the extensions to the right that no
    window from a later line covers.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"), F.length(x).alias("c")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.filter(lines, lambda x: x["c"] > 0).alias("ls"))
    none = "cast(array() as array<struct<wh: bigint, e: int>>)"
    # of the lines from s on: words, hash, how many lines, least hash and its line, ends; every line has a word
    start = f"named_struct('w', 0, 'g', 0L, 'n', 0, 'm', ls[s].h, 'p', s, 'go', true, 'ends', {none})"
    step = f"""if(not a.go or (a.w >= {run_words} and a.w - ls[s].w + x.w >= {run_words}), named_struct('w', a.w, 'g', a.g, 'n', a.n, 'm', a.m, 'p', a.p, 'go', false, 'ends', a.ends), named_struct(
        'w', a.w + x.w, 'g', xxhash64(a.g, x.g), 'n', a.n + 1,
        'm', if(a.w < {run_words}, least(a.m, x.h), a.m), 'p', if(a.w < {run_words} and x.h < a.m, s + a.n, a.p), 'go', true,
        'ends', if(a.w + x.w >= {run_words}, array_append(a.ends, named_struct('wh', xxhash64(a.g, x.g), 'e', s + a.n)), a.ends)))"""
    from_line = F.expr(f"transform(if(size(ls) > 0, sequence(0, size(ls) - 1), cast(array() as array<int>)), s -> struct(s, aggregate(slice(ls, s + 1, {run_words}), {start}, (a, x) -> {step}) as a))")
    starts = rows.select("doc_id", "th", F.filter(from_line, lambda x: F.size(x["a"]["ends"]) > 0).alias("ws"))
    each = F.expr("transform(ws, (x, i) -> struct(x.s as s, x.a.m as fp, i = 0 or ws[i - 1].a.p <> x.a.p as picked, x.a.ends as ends))")
    return starts.select("doc_id", "th", F.inline(each))


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``doc_id, th, cuts``: for documents that repeat earlier runs, the (first, last) line ranges to delete.

    Winnowed fingerprints are joined first: whatever does not hold one that a second place has too is dropped.
    The matches that remain are extended to both sides, window by window: every window around a matched
    position is verified by the hash of all its lines against the earliest place with the same fingerprint
    and hash, so no two places are ever paired beyond that. A run with ``run_words`` words is the union of
    such windows, so all its lines are found, whichever earlier place it repeats.
    """
    marks = materialise(fingerprints(docs.select("doc_id", "text").where("doc_id is not null"), run_words), "lines")
    place = F.struct("doc_id", "s")
    again = marks.where("picked").groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("fp")
    met = materialise(marks.drop("picked").hint("merge").join(again.hint("merge"), "fp", "left_semi").select("fp", "doc_id", "th", "s", F.inline("ends")), "line-matches")
    # the earliest place of every window; only windows with more places matter
    first = met.groupBy("fp", "wh").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("fp", "wh", "a")
    first = materialise(first, "line-first")  # both sides of the join are plain exchanges then, and a hot window can be split
    ext = met.hint("merge").join(first.hint("merge"), ["fp", "wh"]).where("not (doc_id = a.doc_id and s = a.s)").select("doc_id", "th", "s", "e").distinct()
    # ranges of one document are merged first, so that its list of cuts is no longer than its lines
    w = Window.partitionBy("doc_id", "th").orderBy("s", "e")
    ext = ext.withColumn("fresh", F.when(F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) < F.col("s") - 1, 1).otherwise(0)).withColumn("g", F.sum("fresh").over(w))
    ext = ext.groupBy("doc_id", "th", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return ext.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cuts"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated runs, plus ``n_lines`` and ``n_cut`` (of lines that are not blank).

    A run of equal consecutive lines (blank ones aside) with ``run_words`` or more words that occurs earlier,
    in the order of (doc_id, line), is deleted, wherever it occurs: see ``repeated_runs``. Words are counted by single spaces. Null text stays null and
    null doc_ids keep their texts; a text cut whole becomes empty; rows repeated with id and text are not
    repeats of each other and get the same cuts; further columns stay, but for ``n_lines`` and ``n_cut``. Blank lines go with the cuts from texts that are cut, else they stay.
    """
    found = materialise(repeated_runs(docs, run_words), "cuts").select(F.col("doc_id").alias("_cut_id"), F.col("th").alias("_cut_th"), F.col("cuts").alias("_cuts"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_cut")]
    rows = docs.select(*names).withColumn("_cut_h", F.xxhash64("text"))
    # one plan whatever the sizes: texts move once
    rows = rows.hint("merge").join(found.hint("merge"), (rows["doc_id"] == found["_cut_id"]) & (rows["_cut_h"] == found["_cut_th"]), "left")
    # only texts with cuts are split into lines here
    split = "split(text, '\\n', -1)"
    rows = rows.withColumn("_cut_ls", F.when(F.col("_cuts").isNotNull(), F.expr(f"filter({split}, x -> length(x) > 0)")))
    gone = F.expr("aggregate(_cuts, 0, (a, c) -> a + c.e - c.s + 1)")
    n_lines = F.expr(f"cast(size(filter(coalesce({split}, array()), x -> length(x) > 0)) as bigint)")
    # each kept stretch lies between two cuts
    stretches = F.expr("transform(sequence(0, size(_cuts)), k -> slice(_cut_ls, if(k = 0, 1, _cuts[k - 1].e + 2), greatest(0, if(k = size(_cuts), size(_cut_ls), _cuts[k].s) - if(k = 0, 0, _cuts[k - 1].e + 1))))")
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    out = rows.withColumn("n_lines", n_lines).withColumn("n_cut", F.coalesce(gone, F.lit(0)).cast("bigint")).withColumn("text", text)
    return out.select(*names, "n_lines", "n_cut")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the later repeats of runs of RUN_WORDS words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_cut", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}

_ORACLE = """
with l0 as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
l as (select doc_id, t, row_number() over (partition by doc_id order by i) - 1 p, length(t) - length(replace(t, ' ', '')) + 1 w from l0 where length(t) > 0),
c as (select *, sum(w) over (partition by doc_id order by p) upto from l),
win as (select a.doc_id, a.p s, min(b.p) e from c a join c b on b.doc_id = a.doc_id and b.p >= a.p and b.upto - a.upto + a.w >= 50 group by all),
wt as (select win.doc_id, s, e, string_agg(l.t, chr(10) order by l.p) g from win join l on l.doc_id = win.doc_id and l.p between s and e group by all),
f as (select g, min((doc_id, s)) a from wt group by g),
m as (select wt.doc_id, wt.s, a[1] ad, a[2] s2, wt.s - a[2] d from wt join f using (g) where (wt.doc_id, wt.s) <> a),
diag as (select distinct doc_id, ad, d from m),
eq as (select x.doc_id, x.ad, x.d, b.p, b.p - row_number() over (partition by x.doc_id, x.ad, x.d order by b.p) isle
  from diag x join l b on b.doc_id = x.doc_id join l a on a.doc_id = x.ad and a.p = b.p - x.d and a.t = b.t),
hit as (select distinct eq.doc_id, eq.ad, eq.d, isle from eq join m on m.doc_id = eq.doc_id and m.ad = eq.ad and m.d = eq.d and m.s = eq.p),
cut as (select distinct doc_id, p from eq join hit using (doc_id, ad, d, isle)),
n as (select l.doc_id, count(*)::bigint n_lines, count(cut.p)::bigint n_cut, string_agg(l.t, chr(10) order by l.p) filter (cut.p is null) kept from l left join cut using (doc_id, p) group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_cut, 0) n_cut, case when coalesce(n_cut, 0) = 0 then d.text else coalesce(kept, '') end as text
from documents d left join n using (doc_id)"""

ORACLES = {"op1_line_dedup": _ORACLE}
