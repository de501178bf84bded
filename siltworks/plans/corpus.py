"""Preparation of the corpus: clean, deduplicate, cluster, split, window, select, sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import fold_name
from siltworks.operators import cleaning, dedup, sampling, segments, selection
from siltworks.operators.skew import hot_join
from siltworks.runtime import Stage, table
from siltworks.sources.files import Files

SIZE, OVERLAP, LEAST = 256, 32, 16


_tables: dict[tuple, DataFrame] = {}


def _once(s, d, name: str, make) -> DataFrame:
    """A table that one run of the preparation writes and all queries of a session read, as long as its input stays as it is."""
    p = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    f = p.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(p)
    key = (s.sparkContext.applicationId, name, d, f.getModificationTime(), f.getLen())
    held = _tables.get(key)
    if held is None or not Files(s).exists(held._stage_path):  # the folder may have been emptied meanwhile
        held = _tables[key] = Stage(s, name).keep(make(s, d))
    return held


def _clean_documents(s, d) -> DataFrame:
    ok, _ = cleaning.quarantine(cleaning.clean(table(s, d, "documents").select("doc_id", "text", "source", "lang", "parent_document_id", "source_priority")))
    return ok.select("doc_id", "source", "lang", "source_priority", "parent_document_id", F.col("clean_text").alias("text"), F.length("clean_text").alias("n"))


def _clustered(s, d) -> DataFrame:
    docs = accepted(s, d)
    return docs.join(dedup.assign_clusters(docs, dedup.duplicate_groups(docs)), "doc_id")  # both unique by document


def accepted(s, d) -> DataFrame:
    """Documents that cleaning accepts, with clean text and its length."""
    return _once(s, d, "accepted", _clean_documents)


def prepared(s, d) -> DataFrame:
    """The accepted documents after deduplication: each with the canonical record of its duplicates, the cluster of that record and the split of that cluster, so exact and
    near copies never lie in different splits."""
    return _once(s, d, "prepared", _clustered)


def _references(s, d) -> DataFrame:
    """Reference documents, kept outside of ``documents`` in the same id space; they have no priority."""
    return table(s, d, "canonical_documents").select("doc_id", "text", F.lit(None).cast("int").alias("source_priority"))


def _records(s, d) -> DataFrame:
    """Everything a checked pair may refer to."""
    return table(s, d, "documents").select("doc_id", "text", "source_priority").unionByName(_references(s, d))


def _confirmed(s, d) -> DataFrame:
    e = table(s, d, "duplicate_edges")
    ids = _records(s, d).select(F.col("doc_id").alias("a"))
    good = e.where(fold_name(F.col("reason")).isin("exact", "near") & (F.col("canonical_id") != F.col("duplicate_id"))).select(F.least("canonical_id", "duplicate_id").alias("a"), F.greatest("canonical_id", "duplicate_id").alias("b")).distinct()
    known = hot_join(Stage(s, "confirmed").keep(good), ids, "a", "left_semi")
    return hot_join(known, ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def _clean(s, d):
    c = cleaning.clean(table(s, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", "reason", F.length("clean_text").alias("chars"), F.sha2("clean_text", 256).alias("digest"))


def _windows(s, d):
    w = segments.sliding_windows(accepted(s, d).select("doc_id", "n"), "n", SIZE, OVERLAP, LEAST)
    return w.select("doc_id", "segment_index", "start_token", "end_token", "overlap_tokens", "new_tokens", "short_document", "long_document", "tail_fragment")


def _samples(s, d):
    p = accepted(s, d).select("doc_id", segments.encoded("text").alias("ids"))
    w = segments.segment_samples(p, "ids", SIZE, OVERLAP, LEAST)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":segment-"), F.lpad(F.col("segment_index").cast("string"), 5, "0")).alias("sample_id"),
        F.size("input_ids").alias("input_count"), F.size(F.array_remove("labels", -100)).alias("loss_count"), total("input_ids").alias("input_sum"), total("labels").alias("label_sum"),
    )


def _leak_audit(s, d):
    """One row: duplicate groups and equal texts of the prepared documents, and how many of them lie in more than one split."""
    p = prepared(s, d).select("canonical_id", "split", F.sha2("text", 256).alias("digest"))
    torn = lambda c: p.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi")).where("n > 1").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("lo") != F.col("hi"), 1)).alias("torn"))
    return torn("canonical_id").toDF("groups", "torn_groups").join(torn("digest").toDF("equal_texts", "torn_texts"))


def _cluster_report(s, d):
    """Every member of a duplicate group of at least two, with its canonical record and the reason it is there: exact if its text is that of the canonical one."""
    p = prepared(s, d).select("doc_id", "source", "lang", "cluster", "split", "canonical_id", F.sha2("text", 256).alias("digest"))
    size = p.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    canon = p.select(F.col("doc_id").alias("canonical_id"), F.col("digest").alias("c_digest"))
    d2 = hot_join(hot_join(p, size, "canonical_id"), canon, "canonical_id")
    reason = F.when(F.col("doc_id") == F.col("canonical_id"), "canonical").when(F.col("digest") == F.col("c_digest"), "exact").otherwise("near")
    return d2.select("cluster", "canonical_id", "doc_id", "source", "lang", "split", "documents", reason.alias("reason"))


def _resume(s, d):
    """Records that a run still has to stage: those whose source record isn't stored yet. Here the validation and diagnostic records stand for what is stored."""
    stored = prepared(s, d).where("split <> 'train' and parent_document_id is not null").select("parent_document_id").distinct()
    raw = table(s, d, "documents").select("doc_id", "parent_document_id")
    return hot_join(raw, stored, "parent_document_id", "left_anti").select("doc_id")


def _segment_stats(s, d):
    w = segments.sliding_windows(prepared(s, d).select("doc_id", "split", "n"), "n", SIZE, OVERLAP, LEAST)
    return w.groupBy("split").agg(
        F.sum(F.when(F.col("segment_index") == 0, 1).otherwise(0)).alias("documents"), F.count(F.lit(1)).alias("segments"), F.sum("new_tokens").alias("content_tokens"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("loss_tokens").alias("loss_tokens"), F.sum("overlap_tokens").alias("overlap_tokens"), F.sum(F.col("has_bos").cast("int") + F.col("has_eos").cast("int")).alias("special_tokens"),
        F.sum(F.when(F.col("tail_fragment"), 1).otherwise(0)).alias("tail_fragments"),
    )


def _members(s, d):
    return dedup.canonical_members(_records(s, d), dedup.components(_confirmed(s, d)))


def _minhash(s, d):
    return dedup.near_groups(table(s, d, "documents").select("doc_id", "text"))


def _pair_jaccard(s, d):
    texts = _records(s, d)
    e = hot_join(_confirmed(s, d), texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    e = hot_join(e, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return e.select("a", "b", F.round(dedup.jaccard_of("ta", "tb"), 9).alias("similarity"))


def _quotas(s, d):
    return selection.largest_remainder(table(s, d, "documents").groupBy("source").agg(F.sum(F.pmod("doc_id", F.lit(7)) + 1).cast("double").alias("w")), "source", "w", 1_000_000)


def _available(s, d):
    return accepted(s, d).groupBy("source").agg(F.sum("n").cast("long").alias("available"))


def _rebalanced(s, d):
    """Quotas at 99.6 percent of what is there, with two sources a little short, so that the shortage moves."""
    a = _available(s, d)
    total = a.agg(F.sum("available")).first()[0] or 0
    target = int(total * 0.9)
    q = selection.largest_remainder(a.withColumn("w", F.col("available") * F.when(F.col("source") == "recipenook_en", 1.2).otherwise(1.0)), "source", "w", max(target, 1))
    return selection.rebalance(q, a, "source", max(target, 1))


def _token_selection(s, d):
    p = Stage(s, "train").keep(prepared(s, d).where("split = 'train'").select("doc_id", "source", "n"))
    q = p.groupBy("source").agg(F.floor(F.sum("n") * 0.4).cast("long").alias("quota"))
    return selection.within_budget(p, "source", selection.order_key(42, F.col("source"), F.col("doc_id")), "n", q).select("source", "doc_id", "n")


def _validation_subset(s, d):
    p = prepared(s, d).where("split = 'validation'").select("doc_id", F.col("n").cast("long").alias("n"), selection.order_key(3, F.col("doc_id")).alias("k"))
    return selection.first_fit(p, "k", "n", 100_000).select("doc_id", "n")


def _bernoulli(s, d):
    p = table(s, d, "documents").where("text is not null").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    targets = p.groupBy("source").agg((F.sum("bytes") * 0.3).alias("target"))
    return sampling.bernoulli_to_target(p, "source", "bytes", targets, 7, validation=0.1).select("source", "doc_id", "bytes", "routed")


def _weighted(s, d):
    p = table(s, d, "documents").select("doc_id", F.col("source_priority").cast("double").alias("w"))
    return sampling.weighted_without_replacement(p, "w", 100, 11).select("doc_id")


def _weighted_draws(s, d):
    w = table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return sampling.weighted_with_replacement(w, "w", 500, 13, "source").groupBy("source").agg(F.count(F.lit(1)).alias("draws"))


def _mixer(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    w = docs.select("source").distinct().withColumn("w", F.length("source").cast("double"))
    return sampling.mix_sources(docs, "source", w, "w", 500, 17)


def _epoch(s, d):
    return sampling.epoch_order(table(s, d, "documents").select("doc_id"), 5, 1)


def _rank(s, d):
    return sampling.rank_share(_epoch(s, d), "position", 1, 4, drop_last=True)


def _wrapped(s, d):
    r = segments.global_rank(table(s, d, "nation").select("n_nationkey"), "n_nationkey").withColumnRenamed("rank", "position")
    return sampling.wrap_to(r, "position", 60).select("draw", "n_nationkey")


def _buffered(s, d):
    return sampling.buffered_shuffle(_epoch(s, d), "position", 64, 9)


def _error_report(s, d):
    e = table(s, d, "prep_errors")
    return e.dropDuplicates(["source_name", "source_path", "record_index", "stage", "reason"]).groupBy(F.coalesce(fold_name(F.col("source_name")), F.lit("unknown")).alias("source"), "stage", "reason").agg(F.count(F.lit(1)).alias("errors"), F.min("record_index").alias("first_record"))


QUERIES = {
    "clean_documents": _clean,
    "cleaning_reasons": lambda s, d: _clean(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")),
    "error_report": _error_report,
    "length_gate": lambda s, d: cleaning.length_gate(table(s, d, "documents"), 60, 6000),
    "exact_duplicates": lambda s, d: dedup.exact_edges(table(s, d, "documents")),
    "exact_dedup": lambda s, d: dedup.first_of_each(table(s, d, "documents").where("text is not null").select("doc_id", "text", "source"), F.sha2("text", 256), "doc_id").select("doc_id", "source"),
    "pair_jaccard": _pair_jaccard,
    "minhash_near_groups": _minhash,
    "duplicate_components": lambda s, d: dedup.components(_confirmed(s, d)),
    "canonical_members": _members,
    "duplicate_accounting": lambda s, d: dedup.exact_near_accounting(table(s, d, "documents"), _members(s, d), others=_references(s, d)),
    "cluster_splits": lambda s, d: prepared(s, d).select("doc_id", "cluster", "split"),
    "dedup_splits": lambda s, d: prepared(s, d).select("doc_id", "canonical_id", "cluster", "split"),
    "dedup_leak_audit": _leak_audit,
    "cluster_report": _cluster_report,
    "resume_pending": _resume,
    "split_leak_audit": lambda s, d: dedup.leak_audit(table(s, d, "documents").withColumn("split", fold_name(F.col("split"))).where("split is not null"), "parent_document_id", "split"),
    "record_ids": lambda s, d: table(s, d, "documents").select("doc_id", dedup.record_id(F.coalesce("source_name", F.lit("")), F.coalesce("source_path", F.lit("")), F.coalesce("source_index", F.lit(0)), F.col("doc_id").cast("string")).alias("record_key")),
    "sliding_windows": _windows,
    "segment_samples": _samples,
    "segment_stats": _segment_stats,
    "quota_allocation": _quotas,
    "quota_rebalance": _rebalanced,
    "token_selection": _token_selection,
    "validation_subset": _validation_subset,
    "bernoulli_sample": _bernoulli,
    "weighted_sample": _weighted,
    "weighted_draws": _weighted_draws,
    "source_mixer": _mixer,
    "epoch_order": _epoch,
    "rank_share": _rank,
    "wrapped_sampler": _wrapped,
    "buffered_shuffle": _buffered,
}

_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_INNER = _SPACE.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")
_CLEAN = rf"""
c1 as (select *, regexp_replace(replace(regexp_replace(nfc_normalize(text), e'\r\n?', e'\n', 'g'), chr(0), ''), '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', '', 'g') as t from documents),
c2 as (select * exclude (t), regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[{_INNER}]+', ' ', 'g'), e' *\n *', e'\n', 'g'), e'\n{{3,}}', e'\n\n', 'g'), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') as t from c1),
cleaned as (select *, case when t is null or t = '' then 'empty' when length(t) > 200000 then 'length' else 'accepted' end as reason from c2),
accepted as (select doc_id, source, lang, source_priority, parent_document_id, t as text, length(t) as n from cleaned where reason = 'accepted')"""
#: Near duplicates by brute force over all pairs of texts that share a substring, then their canonical records, clusters and splits.
_SPLITS = rf"""{_CLEAN},
reps as (select text, min(doc_id) as rep, any_value(trim(regexp_replace(lower(text), '[{_SPACE}]+', ' ', 'g'), ' ')) as norm from accepted group by 1),
grams as materialized (select rep, substr(norm, i::int, 13) as g from (select rep, norm, unnest(range(1, greatest(length(norm) - 11, 2))) as i from reps) group by 1, 2),
sizes as (select rep, count(*) as c from grams group by 1),
shared as (select x.rep as a, y.rep as b, count(*) as common from grams x join grams y on x.g = y.g and x.rep < y.rep group by 1, 2),
near as (select a, b from shared join sizes p on p.rep = a join sizes q on q.rep = b where common >= 0.8 * (p.c + q.c - common)),
ways as (select a, b from near union select b, a from near),
near_reach as (select a as v, a as r from ways union select b, r from near_reach join ways on a = v),
near_top as (select v, min(r) as r from near_reach group by 1),
grouped as (select p.*, coalesce(t.r, reps.rep) as component from accepted p join reps using (text) left join near_top t on t.v = reps.rep),
canons as (select component, min_by(doc_id, (coalesce(source_priority, 2147483647), doc_id)) as canonical_id from grouped group by 1),
named as (select g.*, canonical_id, 'cluster-' || substr(sha256(coalesce(c.parent_document_id, c.doc_id::varchar)), 1, 24) as cluster from grouped g join canons using (component) join accepted c on c.doc_id = canonical_id),
u as (select *, ('0x' || substr(sha256('42:' || cluster), 1, 16))::ubigint::double / 18446744073709551616::double as x from named),
splits as (select * exclude (x), case when x < 0.05 then 'validation' when x < 0.1 then 'diagnostic' else 'train' end as split from u)"""


def _windows_sql(base: str, rows: str) -> str:
    return f"""{base},
k as (select *, case when n <= {SIZE} then 1 else 1 + ceil((n - {SIZE}) / {SIZE - OVERLAP}.0)::int end as segments from {rows}),
w0 as (select *, unnest(range(segments))::int as segment_index from k),
w1 as (select *, (segment_index * {SIZE - OVERLAP})::int as start_token, least(segment_index * {SIZE - OVERLAP} + {SIZE}, n)::int as end_token from w0),
w2 as (select *, case when segment_index = 0 then 0 else least({OVERLAP}, end_token - start_token) end::int as overlap_tokens from w1),
w as (select *, (end_token - start_token - overlap_tokens)::int as new_tokens, n < {LEAST} as short_document, n > {SIZE} as long_document,
      segment_index = segments - 1 and segment_index > 0 and end_token - start_token - overlap_tokens < {LEAST} as tail_fragment,
      (segment_index = 0)::int as bos, (segment_index = segments - 1)::int as eos from w2)"""


_WINDOWS = _windows_sql(_CLEAN, "accepted")
_LINKS = """
records as (select doc_id, text, source_priority from documents union all select doc_id, text, null from canonical_documents),
e as (select distinct least(canonical_id, duplicate_id) as a, greatest(canonical_id, duplicate_id) as b from duplicate_edges
      where lower(trim(reason, e' \\t\\n\\r')) in ('exact', 'near') and canonical_id <> duplicate_id
        and canonical_id in (select doc_id from records) and duplicate_id in (select doc_id from records)),
both_ways as (select a, b from e union select b, a from e),
reach as (select a as v, a as r from both_ways union select b, r from reach join both_ways on a = v),
comps as (select v as id, min(r) as component from reach group by 1),
canon as (select component, min_by(id, (coalesce(source_priority, 2147483647), id)) as canonical_id from comps join records on doc_id = id group by 1),
members as (select id as doc_id, component, canonical_id from comps join canon using (component))"""
_U = "('0x' || substr(sha256({0}), 1, 16))::ubigint::double / 18446744073709551616::double"

ORACLE: dict[str, str] = {
    "clean_documents": f"with {_CLEAN} select doc_id, reason, case when reason = 'accepted' then length(t) end::int as chars, case when reason = 'accepted' then sha256(t) end as digest from cleaned",
    "cleaning_reasons": f"with {_CLEAN} select reason, count(*) as documents, coalesce(sum(case when reason = 'accepted' then length(t) end), 0)::bigint as chars from cleaned group by 1",
    "error_report": """select coalesce(nullif(lower(trim(source_name, e' \\t\\n\\r')), ''), 'unknown') as source, stage, reason, count(*) as errors, min(record_index) as first_record
from (select distinct source_name, source_path, record_index, stage, reason from prep_errors) group by 1, 2, 3""",
    "length_gate": """select source, count(*) as records, sum((coalesce(length(text), 0) between 60 and 6000)::int)::bigint as eligible, sum((coalesce(length(text), 0) < 60)::int)::bigint as short,
sum((coalesce(length(text), 0) > 6000)::int)::bigint as long from documents group by 1""",
    "exact_duplicates": "select * from (select first_value(doc_id) over (partition by text order by doc_id) as canonical_id, doc_id as duplicate_id from documents where text is not null) where canonical_id <> duplicate_id",
    "exact_dedup": "select doc_id, source from documents where text is not null qualify row_number() over (partition by text order by doc_id) = 1",
    "duplicate_components": f"with recursive {_LINKS} select id, component from comps",
    "canonical_members": f"with recursive {_LINKS} select doc_id, component, canonical_id from members",
    "duplicate_accounting": f"""with recursive {_LINKS}
select d.source, sum((sha256(d.text) = sha256(c.text)) is true)::bigint as exact, sum(((sha256(d.text) = sha256(c.text)) is not true)::int)::bigint as near
from members m join documents d using (doc_id) join records c on c.doc_id = m.canonical_id where m.doc_id <> m.canonical_id group by 1""".replace("sum((sha256(d.text) = sha256(c.text)) is true)", "sum(((sha256(d.text) = sha256(c.text)) is true)::int)"),
    "cluster_splits": f"with recursive {_SPLITS} select doc_id, cluster, split from splits",
    "dedup_splits": f"with recursive {_SPLITS} select doc_id, canonical_id, cluster, split from splits",
    "dedup_leak_audit": f"""with recursive {_SPLITS}, a as (select count(*) as n, count(distinct split) as k from splits group by canonical_id having count(*) > 1), b as (select count(*) as n, count(distinct split) as k from splits group by text having count(*) > 1)
select (select count(*) from a) as groups, (select count(*) from a where k > 1) as torn_groups, (select count(*) from b) as equal_texts, (select count(*) from b where k > 1) as torn_texts""",
    "cluster_report": f"""with recursive {_SPLITS} select s.cluster, s.canonical_id, s.doc_id, s.source, s.lang, s.split, count(*) over (partition by s.canonical_id) as documents,
case when s.doc_id = s.canonical_id then 'canonical' when s.text = c.text then 'exact' else 'near' end as reason from splits s join splits c on c.doc_id = s.canonical_id qualify count(*) over (partition by s.canonical_id) > 1""",
    "resume_pending": f"""with recursive {_SPLITS} select doc_id from documents where parent_document_id is null or parent_document_id not in (select parent_document_id from splits where split <> 'train' and parent_document_id is not null)""",
    "minhash_near_groups": rf"""with recursive r as (select text, min(doc_id) as rep, any_value(trim(regexp_replace(lower(text), '[{_SPACE}]+', ' ', 'g'), ' ')) as norm from documents where text is not null group by 1),
g as materialized (select rep, substr(norm, i::int, 13) as g from (select rep, norm, unnest(range(1, greatest(length(norm) - 11, 2))) as i from r) group by 1, 2), z as (select rep, count(*) as c from g group by 1),
h as (select x.rep as a, y.rep as b, count(*) as common from g x join g y on x.g = y.g and x.rep < y.rep group by 1, 2), near as (select a, b from h join z p on p.rep = a join z q on q.rep = b where common >= 0.8 * (p.c + q.c - common)),
ways as (select a, b from near union select b, a from near), reach as (select a as v, a as r from ways union select b, r from reach join ways on a = v), top as (select v, min(r) as r from reach group by 1)
select d.doc_id, coalesce(t.r, r.rep, d.doc_id) as group_id from documents d left join r using (text) left join top t on t.v = r.rep""",
    "pair_jaccard": rf"""with recursive {_LINKS}, n as (select doc_id, trim(regexp_replace(lower(text), '[{_SPACE}]+', ' ', 'g'), ' ') as norm from records where text is not null),
g as (select doc_id, norm, list_distinct(list_transform(range(1, greatest(length(norm) - 11, 2)), lambda i: substr(norm, i::int, 13))) as g from n where doc_id in (select a from e union select b from e))
select a, b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 9) as similarity from e left join g x on x.doc_id = a left join g y on y.doc_id = b""",
    "split_leak_audit": """select parent_document_id, array_to_string(list_sort(list(distinct s)), ',') as splits, count(*) as records
from (select parent_document_id, lower(trim(split, e' \\t\\n\\r')) as s from documents) where parent_document_id is not null and s <> '' group by 1 having count(distinct s) > 1""",
    "record_ids": "select doc_id, sha256(concat(coalesce(source_name, ''), chr(0), coalesce(source_path, ''), chr(0), coalesce(source_index, 0), chr(0), doc_id)) as record_key from documents",
    "sliding_windows": f"with {_WINDOWS} select doc_id, segment_index, start_token, end_token, overlap_tokens, new_tokens, short_document, long_document, tail_fragment from w",
    "segment_samples": f"""with {_WINDOWS}
select doc_id || ':segment-' || lpad(segment_index::varchar, 5, '0') as sample_id, (end_token - start_token + bos + eos)::int as input_count, (new_tokens + eos)::int as loss_count,
(coalesce(list_sum(list_transform(regexp_extract_all(substr(text, start_token + 1, end_token - start_token), '(?s).'), lambda c: unicode(c))), 0) + bos + 2 * eos)::bigint as input_sum,
(coalesce(list_sum(list_transform(regexp_extract_all(substr(text, start_token + overlap_tokens + 1, new_tokens), '(?s).'), lambda c: unicode(c))), 0) - 100 * (bos + overlap_tokens) + 2 * eos)::bigint as label_sum from w""",
    "segment_stats": f"""with recursive {_windows_sql(_SPLITS, 'splits')} select split, sum((segment_index = 0)::int)::bigint as documents, count(*) as segments, sum(new_tokens)::bigint as content_tokens,
sum(end_token - start_token + bos + eos)::bigint as input_tokens, sum(new_tokens + eos)::bigint as loss_tokens, sum(overlap_tokens)::bigint as overlap_tokens, sum(bos + eos)::bigint as special_tokens,
sum(tail_fragment::int)::bigint as tail_fragments from w group by 1""",
    "quota_allocation": """with w as (select source, sum(doc_id % 7 + 1)::double as w from documents group by 1),
r as (select source, 1000000 * w / sum(w) over () as raw from w), q as (select source, raw, floor(raw)::bigint as whole from r)
select source, (whole + (row_number() over (order by raw - whole desc, source) <= 1000000 - sum(whole) over ())::int)::bigint as quota from q""",
    "token_selection": f"""with recursive {_SPLITS}, p as (select doc_id, source, n, {_U.format("concat('42:', source, ':', doc_id)")} as k from splits where split = 'train'),
q as (select source, floor(sum(n) * 0.4)::bigint as quota from p group by 1),
r as (select p.*, coalesce(sum(n) over (partition by source order by k rows between unbounded preceding and 1 preceding), 0) as before from p)
select source, doc_id, n::int as n from r join q using (source) where before < quota""",
    "bernoulli_sample": f"""with p as (select doc_id, source, strlen(text) as bytes from documents where text is not null), h as (select source, sum(bytes) as have, sum(bytes) * 0.3::double as target from p group by 1)
select source, doc_id, bytes, case when {_U.format("concat('8:', source, ':', doc_id)")} < 0.1 then 'validation' else 'train' end as routed from p join h using (source)
where {_U.format("concat('7:', source, ':', doc_id)")} < target / have""",
    "weighted_sample": f"""select doc_id from (select doc_id, pow(greatest({_U.format("concat('11:', doc_id)")}, 1e-12), 1 / source_priority::double) as p from documents where source_priority > 0) order by p desc, doc_id limit 100""",
    "epoch_order": "select doc_id, row_number() over (order by sha256(concat('5:1:', doc_id)) || doc_id) as position from documents",
    "rank_share": "with p as (select doc_id, row_number() over (order by sha256(concat('5:1:', doc_id)) || doc_id) as position, count(*) over () as n from documents) select doc_id, position from p where (position - 1) % 4 = 1 and position <= n // 4 * 4",
    "wrapped_sampler": "with n as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as p, count(*) over () as m from nation) select i as draw, n_nationkey from range(60) r(i) join n on p = i % m",
    "buffered_shuffle": f"""with p as (select doc_id, row_number() over (order by sha256(concat('5:1:', doc_id)) || doc_id) as position from documents)
select doc_id, position, ((position - 1) // 64 * 64 + row_number() over (partition by (position - 1) // 64 order by {_U.format("concat('9:', position)")}, position))::bigint as shuffled from p""",
}

ORACLE |= {
    "quota_rebalance": f"""with {_CLEAN}, a as (select source, sum(n)::bigint as available from accepted group by 1), t as (select greatest(floor(sum(available) * 0.9::double)::bigint, 1) as target from a),
w as (select source, available, available * case when source = 'recipenook_en' then 1.2::double else 1.0::double end as w from a),
r as (select source, available, target, target * w / sum(w) over () as raw from w, t), q as (select *, floor(raw)::bigint as whole from r),
k as (select source, available, target, (whole + (row_number() over (order by raw - whole desc, source) <= target - sum(whole) over ())::int)::bigint as quota from q),
l as (select *, greatest(quota - available, 0) as lack, greatest(available - quota, 0) as over_ from k),
m as (select *, sum(lack) over () as tl, sum(over_) over () as tov, sum(available) over () as ta from l),
g as (select *, tl > 0 and tl <= target * 0.01::double and ta >= target and tov >= tl as moves from m),
i as (select *, case when moves and over_ > 0 then tl * over_ / tov::double else 0::double end as raw2 from g), j as (select *, floor(raw2)::bigint as inc from i)
select source, quota, available, case when moves then quota - lack + inc + (over_ > 0 and row_number() over (order by over_ > 0 desc, raw2 - inc desc, source) <= tl - sum(inc) over ())::int else quota end::bigint as effective from j""",
    "validation_subset": f"""with recursive {_SPLITS}, o as (select doc_id, n::bigint as n, row_number() over (order by {_U.format("concat('3:', doc_id)")}) as i from splits where split = 'validation' and n <= 100000),
f as (select 0::bigint as i, null::bigint as doc_id, 0::bigint as n, false as taken, 100000::bigint as room union all select o.i, o.doc_id, o.n, o.n <= f.room, f.room - case when o.n <= f.room then o.n else 0 end from f join o on o.i = f.i + 1)
select doc_id, n from f where taken""",
    "weighted_draws": f"""with w as (select source, count(*)::double as w from documents where source is not null group by 1), h as (select source, sum(w) over (order by source) / sum(w) over () as hi from w),
d as (select {_U.format("concat('13:', i)")} as u from range(500) r(i)), p as (select (select min_by(source, hi) from h where hi > u) as source from d) select source, count(*) as draws from p group by 1""",
    "source_mixer": f"""with n as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as c from documents where source is not null),
h as (select source, sum(w) over (order by source) / sum(w) over () as hi from (select distinct source, length(source)::double as w from n)),
d as (select i as draw, {_U.format("concat('17:', i)")} as u, {_U.format("concat('18:', i)")} as v from range(500) r(i)), p as (select draw, v, (select min_by(source, hi) from h where hi > u) as source from d)
select draw, source, doc_id from p join n using (source) where i = floor(v * c)""",
}
