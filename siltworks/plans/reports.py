"""Counters, shares, packing, tokenizer quality, overlap and log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import profiles, segments
from siltworks.operators.skew import hot_join
from siltworks.plans.corpus import _CLEAN, _SPLITS, _WINDOWS, LEAST, OVERLAP, SIZE, _windows_sql, accepted, prepared
from siltworks.runtime import Stage, table


def _docs(s, d):
    return table(s, d, "documents")


def _source_counters(s, d):
    x = _docs(s, d).withColumn("digest", F.sha2("text", 256))
    first = x.where("text is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    x = x.select("doc_id", "source", F.length("text").alias("chars")).join(first, "doc_id", "left")
    n = F.coalesce("chars", F.lit(0))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("first").alias("unique_documents"), F.sum(n).alias("chars"), F.sum(F.when(F.col("first"), n).otherwise(0)).alias("unique_chars"), F.max(n).alias("longest"))


def _source_report(s, d):
    """All counters of the preparation per source: what came in, what cleaning kept, what is canonical or a copy, what the windows give, and the documents of each split."""
    raw = _docs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    p = prepared(s, d).select("doc_id", "source", "n", "split", "canonical_id", F.sha2("text", 256).alias("digest"))
    canon = p.select(F.col("doc_id").alias("canonical_id"), F.col("digest").alias("c_digest"))
    own, same = F.col("doc_id") == F.col("canonical_id"), F.col("digest") == F.col("c_digest")
    k = segments.window_count(F.col("n"), SIZE, OVERLAP)
    kept = hot_join(p, canon, "canonical_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("accepted"), F.sum("n").alias("clean_chars"), F.sum(own.cast("int")).alias("canonical"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("unique_chars"),
        F.sum((~own & same).cast("int")).alias("exact_duplicates"), F.sum((~own & ~same).cast("int")).alias("near_duplicates"),
        F.sum(k).alias("segments"), F.sum(F.col("n") + 1).alias("loss_tokens"), F.sum(F.col("n") + (k - 1) * OVERLAP + 2).alias("input_tokens"), F.sum(F.greatest(F.col("n") - SIZE, F.lit(0))).alias("recovered_tokens"),
        *[F.sum((F.col("split") == x).cast("int")).alias(x) for x in ("train", "validation", "diagnostic")],
    )
    return raw.join(kept, "source", "left").na.fill(0)


def _language_counters(s, d):
    return prepared(s, d).groupBy("lang").pivot("split", ["train", "validation", "diagnostic"]).agg(F.sum("n")).na.fill(0).select("lang", *[F.col(c).cast("long").alias(c) for c in ("train", "validation", "diagnostic")])


def _source_shares(s, d):
    return profiles.shares(_docs(s, d).where("text is not null").withColumn("n", F.length("text")), "source", "n", {"webmoss_en": 0.2, "webmoss_zh": 0.2, "codeforge_en": 0.1})


def _tails(s, d):
    w = segments.sliding_windows(accepted(s, d).select("doc_id", "source", "n"), "n", SIZE, OVERLAP, LEAST)
    return w.groupBy("source").agg(
        F.sum(F.when(F.col("long_document") & (F.col("segment_index") == 0), 1).otherwise(0)).alias("long_documents"),
        F.sum(F.when(F.col("segment_index") == 0, F.greatest(F.col("n") - SIZE, F.lit(0))).otherwise(0)).alias("recovered_tokens"), F.sum(F.when(F.col("tail_fragment"), 1).otherwise(0)).alias("tail_fragments"),
    )


def _lengths(s, d):
    return accepted(s, d).select("doc_id", "n")


def _packing(s, d):
    out = None
    lengths = Stage(s, "lengths").keep(_lengths(s, d))
    for m in (4, 16, 64):
        one = segments.packing_efficiency(lengths, "doc_id", "n", m, 2048).withColumn("micro_batch", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def _stream_pack(s, d):
    x = segments.stream_pack(accepted(s, d).select("doc_id", "text"), "doc_id", "text", 512, 8, segments.encoded)
    return x.select("batch", "sequence", F.size("input_ids").alias("tokens"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("input_sum"), (F.size("labels") - F.size(F.array_remove("labels", -100))).alias("ignored"))


def _isolated(s, d):
    """Texts above the capacity are cut into windows without overlap, so every sample fits and no token is left out or repeated."""
    w = segments.sliding_windows(_lengths(s, d), "n", 2048, 0).select("doc_id", "new_tokens", F.struct("doc_id", "segment_index").alias("sample"))
    p = segments.batches(w, "sample", 64).drop("sample")
    return segments.isolated_pack(p, "batch", "place", "new_tokens", 2048).select("batch", "sequence", "doc_id")


def _padded(s, d):
    b = segments.batches(_lengths(s, d), "doc_id", 16)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("samples"), segments.padded_length(F.max("n"), 8).alias("length"), F.sum("n").alias("tokens")).withColumn("padding", F.col("samples") * F.col("length") - F.col("tokens"))


def _positions(s, d):
    w = segments.sliding_windows(_lengths(s, d), "n", SIZE, OVERLAP, LEAST)
    n = F.col("new_tokens").cast("long")  # each window is a run, in which positions go from 0 to n - 1
    return w.groupBy("doc_id").agg(F.sum(n * (n - 1) / 2).cast("long").alias("position_sum"), (F.max("new_tokens") - 1).alias("last"))


def _quantiles(s, d):
    fi = profiles.floor_index(accepted(s, d), "source", "n", [0.5, 0.9, 0.95])
    other = accepted(s, d).groupBy("source").agg(profiles.nearest_rank("n", 0.5).cast("int").alias("nearest50"), profiles.nearest_rank("n", 0.95).cast("int").alias("nearest95"), F.round(profiles.interpolated("n", 0.9), 6).alias("linear90"))
    return fi.join(other, "source")


def _buckets(s, d):
    n = F.col("n")
    bucket = F.when(n < 32, "<32").when(n < 128, "32-127").when(n < 512, "128-511").when(n < 2048, "512-2047").otherwise(">=2048")
    return _lengths(s, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chars"))


def _diagnosis(s, d):
    p = prepared(s, d)
    return p.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"), F.countDistinct("cluster").alias("clusters")).withColumn(
        "duplicate_rate", F.round((F.col("documents") - F.col("distinct_texts")) / F.col("documents"), 9)
    )


def _top_sources(s, d):
    return accepted(s, d).groupBy("source").agg(F.sum("n").alias("tokens")).orderBy(F.desc("tokens"), "source").limit(5)


def _char_counts(s, d):
    return profiles.character_counts(_docs(s, d))


def _vocabulary(s, d):
    c = _char_counts(s, d).withColumn("bytes", F.octet_length("token"))
    median = profiles.weighted_quantile(c, "bytes", "n", 0.5).scalar()
    return c.agg(F.count(F.lit(1)).alias("used"), F.sum("n").alias("total"), F.round(F.sum(F.col("n") * F.col("bytes")) / F.sum("n"), 6).alias("mean_bytes"), F.sum(F.when(F.col("bytes") == 1, 1).otherwise(0)).alias("single_byte")).withColumn("median_bytes", median)


def _top_tokens(s, d):
    return _char_counts(s, d).orderBy(F.desc("n"), "token").limit(20)


def _profile(s, d):
    return profiles.text_profile(_docs(s, d).select("text", F.col("lang").alias("language"), "source"))


def _ratings(s, d):
    p = profiles.text_profile(_docs(s, d).select("text", F.col("lang").alias("language"), "source"), by=("source",)).where("source is not null")
    return p.select("source", profiles.rating(F.col("bytes_per_char"), 1.2, 2.6, smaller_is_better=True).alias("density"), profiles.rating(F.col("latin_ratio"), 0.7, 0.4).alias("latin"))


def _overlap(s, d):
    x = _docs(s, d).where("text is not null")
    return profiles.overlap(x.where("pmod(doc_id, 2) = 0"), x.where("pmod(doc_id, 2) = 1"), F.sha2("text", 256))


def _steps(s, d):
    return segments.optimizer_steps(Stage(s, "lengths").keep(_lengths(s, d)), "doc_id", "n", 4, 2048, 2, 4)


def _losses(s, d):
    """The event stream stands in for a table of evaluated rows: value is a loss, the user id its number of tokens."""
    e = table(s, d, "events").select("event_type", (F.col("value") / 100).alias("loss"), (F.col("user_id") + 1).alias("tokens"))
    return profiles.loss_summary(e.groupBy("event_type").agg(F.max("loss").alias("loss"), F.sum("tokens").alias("tokens")), "loss", "tokens")


def _recent(s, d):
    e = table(s, d, "events").select("event_id", "value")
    return profiles.recent_window(e, "event_id", "value").select("event_id", F.round("window_mean", 4).alias("window_mean"), F.round("window_variance", 2).alias("window_variance"), F.round("window_change", 4).alias("window_change"))


def _daily_stop(s, d):
    daily = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    series = daily.groupBy("event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("values"))
    return series.select("event_type", F.size("values").alias("evaluations"), profiles.early_stop(F.col("values"), 4).alias("stopped_at"), F.round(profiles.ema(F.col("values"), 0.1), 6).alias("smoothed"))


def _visibility(s, d):
    """Attention pairs of packed batches: each position sees earlier positions of its own document and itself."""
    p = segments.batches(_lengths(s, d), "doc_id", 4)
    return p.groupBy("batch").agg(F.sum("n").cast("int").alias("positions"), F.sum(segments.visible_pairs(F.col("n"))).alias("visible_pairs"))


def _fragmentation(s, d):
    """How words split into runs of one character class, per source: pieces a word, longest, and words of a single piece."""
    words = _docs(s, d).where("text is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.size(F.regexp_extract_all("w", F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,3}|_"), F.lit(0))))
    return counts.groupBy("source").agg(F.sum("n").alias("words"), F.round(F.sum(F.col("n") * F.col("pieces")) / F.sum("n"), 6).alias("pieces_per_word"), F.max("pieces").alias("most_pieces"), F.round(F.sum(F.when(F.col("pieces") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("single_piece_rate"))


QUERIES = {
    "visibility_audit": _visibility,
    "fragmentation": _fragmentation,
    "source_counters": _source_counters,
    "source_report": _source_report,
    "language_counters": _language_counters,
    "source_shares": _source_shares,
    "tail_fragments": _tails,
    "packing_efficiency": _packing,
    "optimizer_steps": _steps,
    "stream_pack": _stream_pack,
    "isolated_pack": _isolated,
    "padded_batches": _padded,
    "position_ids": _positions,
    "length_quantiles": _quantiles,
    "length_buckets": _buckets,
    "dataset_diagnosis": _diagnosis,
    "top_sources": _top_sources,
    "token_entropy": lambda s, d: profiles.entropy_and_gini(_char_counts(s, d), "n"),
    "vocabulary_stats": _vocabulary,
    "top_tokens": _top_tokens,
    "text_profile": _profile,
    "source_ratings": _ratings,
    "dataset_overlap": _overlap,
    "loss_summary": _losses,
    "recent_window": _recent,
    "early_stop": _daily_stop,
}

_LEN = f"{_CLEAN}, p as (select doc_id, n, row_number() over (order by doc_id) - 1 as i, count(*) over () as total from accepted)"
_PACK = """select {m} as micro_batch, count(*) * {m} as raw_samples, sum(t)::bigint as content_tokens, sum(q)::bigint as packed_sequences, (sum(q) * 2048)::bigint as padded_tokens, (sum(q) * 2048 - sum(t))::bigint as padding_tokens,
round((sum(q) * 2048 - sum(t)) / (sum(q) * 2048), 9) as padding_ratio from (select i // {m} as b, sum(n) as t, greatest(1, ceil(sum(n) / 2048.0)) as q from p where i < total // {m} * {m} group by 1)"""
_CHARS = "c as (select token, count(*) as n from (select unnest(regexp_extract_all(text, '(?s).')) as token from documents where text is not null) group by 1)"
_RATIO = {k: f"round(coalesce(sum(length(text) - length(regexp_replace(text, '{p}', '', 'g'))) / sum(length(text)), 0), 9) as {k}_ratio" for k, p in {"latin": "[A-Za-z]", "digits": "[0-9]", "cjk": r"[\x{4E00}-\x{9FFF}]", "ascii_space": r"[ \t\n\r]", "ascii_punctuation": r"[!-/:-@\[-`{-~]"}.items()}
_PROFILE = f"""select language, source, count(*) as texts, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes, {', '.join(_RATIO.values())},
round(coalesce(sum(strlen(text)) / sum(length(text)), 0), 9) as bytes_per_char from (select text, lang as language, source from documents where text is not null) group by grouping sets ((), (language), (source))"""

ORACLE: dict[str, str] = {
    "visibility_audit": f"""with {_CLEAN}, r as (select n, (row_number() over (order by doc_id) - 1) // 4 as batch from accepted)
select batch, sum(n)::int as positions, sum(n * (n + 1) / 2)::bigint as visible_pairs from r group by 1""",
    "fragmentation": """with w as (select source, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as w from documents where text is not null), c as (select source, len(regexp_extract_all(w, '[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,3}|_')) as pieces from w)
select source, count(*) as words, round(sum(pieces) / count(*), 6) as pieces_per_word, max(pieces)::int as most_pieces, round(sum((pieces = 1)::int) / count(*), 6) as single_piece_rate from c group by 1""",
    "tail_fragments": f"""with {_WINDOWS} select source, sum((long_document and segment_index = 0)::int)::bigint as long_documents, sum(case when segment_index = 0 then greatest(n - {SIZE}, 0) else 0 end)::bigint as recovered_tokens,
sum(tail_fragment::int)::bigint as tail_fragments from w group by 1""",
    "position_ids": f"""with {_WINDOWS} select doc_id, sum(new_tokens * (new_tokens - 1) / 2)::bigint as position_sum, (max(new_tokens) - 1)::int as last from w group by 1""",
    "optimizer_steps": f"""with {_LEN}, m as (select i // 4 as b, sum(n) as t, greatest(1, ceil(sum(n) / 2048.0)) as q, max(total) // 32 as steps from p group by 1)
select max(steps)::bigint as steps, round(sum(t) / max(steps), 6) as mean_content_tokens, round(sum(q) * 2048 / max(steps), 6) as mean_padded_tokens, round(sum(q) / max(steps), 6) as mean_sequences from m where b < steps * 8""",
    "source_ratings": """with x as (select source, sum(strlen(text)) / sum(length(text)) as b, sum(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / sum(length(text)) as l from documents where text is not null group by 1)
select source, case when round(b, 9) <= 1.2 then 'strong' when round(b, 9) <= 2.6 then 'reasonable' else 'weak' end as density, case when round(l, 9) >= 0.7 then 'strong' when round(l, 9) >= 0.4 then 'reasonable' else 'weak' end as latin from x""",
    "stream_pack": f"""with {_CLEAN}, r as (select text, n, (row_number() over (order by doc_id) - 1) // 8 as batch, (row_number() over (order by doc_id) - 1) % 8 as place from accepted),
o as (select *, sum(n) over (partition by batch order by place) - n as base from r),
t as (select batch, place, base + i as pos, unicode(substr(text, i::int + 1, 1)) as id from (select *, unnest(range(n)) as i from o)),
l as (select *, lag(place) over (partition by batch order by pos) as prior from t)
select batch, (pos // 512)::int as sequence, count(*)::int as tokens, sum(id)::bigint as input_sum, sum((pos % 512 > 0 and prior <> place)::int)::int as ignored from l group by 1, 2""",
    "source_counters": """with x as (select *, text is not null and row_number() over (partition by text order by doc_id) = 1 as first from documents)
select source, count(*) as documents, sum(first::int)::bigint as unique_documents, sum(coalesce(length(text), 0))::bigint as chars, sum(case when first then length(text) else 0 end)::bigint as unique_chars, max(coalesce(length(text), 0))::int as longest from x group by 1""",
    "language_counters": f"""with recursive {_SPLITS} select lang, coalesce(sum(n) filter (split = 'train'), 0)::bigint as train, coalesce(sum(n) filter (split = 'validation'), 0)::bigint as validation, coalesce(sum(n) filter (split = 'diagnostic'), 0)::bigint as diagnostic from splits group by 1""",
    "source_shares": """with x as (select source, sum(length(text))::bigint as total from documents where text is not null group by 1), y as (select *, round(total / sum(total) over (), 9) as share from x)
select *, round(share - case source when 'webmoss_en' then 0.2 when 'webmoss_zh' then 0.2 when 'codeforge_en' then 0.1 else 0 end::double, 9) as delta from y""",
    "packing_efficiency": f"with {_LEN} {_PACK.format(m=4)} union all {_PACK.format(m=16)} union all {_PACK.format(m=64)}",
    "padded_batches": f"with {_LEN} select i // 16 as batch, count(*) as samples, (ceil(max(n) / 8.0) * 8)::int as length, sum(n)::bigint as tokens, (count(*) * ceil(max(n) / 8.0) * 8 - sum(n))::bigint as padding from p group by 1",
    "length_buckets": f"""with {_CLEAN} select case when n < 32 then '<32' when n < 128 then '32-127' when n < 512 then '128-511' when n < 2048 then '512-2047' else '>=2048' end as bucket, count(*) as documents, sum(n)::bigint as chars from accepted group by 1""",
    "length_quantiles": f"""with {_CLEAN}, l as (select source, list_sort(list(n)) as v, count(*) as c from accepted group by 1)
select source, v[((c - 1) * 0.5)::double::decimal(38, 9)::bigint + 1] as p50, v[floor((c - 1) * 0.9::double)::bigint + 1]::int as p90, v[floor((c - 1) * 0.95::double)::bigint + 1]::int as p95, v[c]::int as largest,
v[ceil(c * 0.5::double)::bigint]::int as nearest50, v[ceil(c * 0.95::double)::bigint]::int as nearest95, (select round(quantile_cont(n, 0.9), 6) from accepted s where s.source = l.source) as linear90 from l""".replace("v[((c - 1) * 0.5)::double::decimal(38, 9)::bigint + 1] as p50", "v[floor((c - 1) * 0.5::double)::bigint + 1]::int as p50"),
    "dataset_diagnosis": f"""with recursive {_SPLITS} select count(*) as documents, sum(n)::bigint as tokens, round(avg(n), 6) as mean_tokens, min(n)::int as shortest, max(n)::int as longest, count(distinct text) as distinct_texts, count(distinct cluster) as clusters,
round((count(*) - count(distinct text)) / count(*), 9) as duplicate_rate from splits""",
    "top_sources": f"with {_CLEAN} select source, sum(n)::bigint as tokens from accepted group by 1 order by 2 desc, 1 limit 5",
    "token_entropy": f"""with {_CHARS}, r as (select n, row_number() over (order by n) as r, sum(n) over () as t, count(*) over () as k from c)
select max(k)::bigint as items, max(t)::bigint as total, round(-sum(n / t * log2(n / t)), 6) as entropy_bits, round(-sum(n / t * log2(n / t)) / log2(max(k)), 6) as normalised_entropy,
round(2 * sum(r * n) / (max(k) * max(t)) - (max(k) + 1) / max(k), 6) as gini from r""",
    "vocabulary_stats": f"""with {_CHARS}, b as (select n, strlen(token) as bytes from c), h as (select bytes, sum(n) as n from b group by 1), q as (select bytes, sum(n) over (order by bytes) as u, sum(n) over () as t from h)
select count(*) as used, sum(n)::bigint as total, round(sum(n * bytes) / sum(n), 6) as mean_bytes, sum((bytes = 1)::int)::bigint as single_byte, (select min(bytes) from q where u >= t * 0.5)::int as median_bytes from b""",
    "top_tokens": f"with {_CHARS} select token, n from c order by n desc, token limit 20",
    "text_profile": _PROFILE,
    "dataset_overlap": """with a as (select distinct text from documents where doc_id % 2 = 0 and text is not null), b as (select distinct text from documents where doc_id % 2 = 1 and text is not null), s as (select (select count(*) from a) as l, (select count(*) from b) as r, (select count(*) from (from a intersect from b)) as both_sides)
select l as left_items, r as right_items, both_sides as shared, round(coalesce(both_sides / least(l, r), 0), 9) as share from s""",
    "loss_summary": """with e as (select event_type, max(value / 100) as loss, sum(user_id + 1) as tokens from events group by 1)
select round(sum(loss * tokens) / sum(tokens), 6) as cross_entropy, round(exp(sum(loss * tokens) / sum(tokens)), 6) as perplexity, round(max(loss), 6) as largest from e""",
    "recent_window": """select event_id, round(avg(value) over w, 4) as window_mean, round(var_pop(value) over w, 2) as window_variance, round(value - first_value(value) over w, 4) as window_change
from events window w as (order by event_id rows between 99 preceding and current row)""",
}

ORACLE |= {
    "isolated_pack": f"""with recursive {_CLEAN}, w as (select doc_id, unnest(range(greatest(1, ceil(n / 2048.0)::int)))::int as i, n from accepted), x as (select doc_id, i, least(2048, n - i * 2048) as t, row_number() over (order by doc_id, i) - 1 as r from w),
o as (select doc_id, t, r // 64 as batch, r % 64 as place from x),
f as (select batch, place, doc_id, 0::bigint as sequence, t as used from o where place = 0
  union all select o.batch, o.place, o.doc_id, f.sequence + (f.used + o.t > 2048)::int, case when f.used + o.t > 2048 then o.t else f.used + o.t end from f join o on o.batch = f.batch and o.place = f.place + 1)
select batch, sequence, doc_id from f""",
    "early_stop": """with recursive e as (select event_type, ts::date as day, round(avg(value), 6) as v from events group by 1, 2), o as (select *, row_number() over (partition by event_type order by day) as i from e),
f as (select event_type, i, case when v < 'inf'::double then v else 'inf'::double end as best, 0 as bad, null::int as stop, v as ema from o where i = 1
  union all select o.event_type, o.i, case when o.v < f.best then o.v else f.best end, case when o.v < f.best then 0 else f.bad + 1 end,
  coalesce(f.stop, case when o.v >= f.best and f.bad + 1 >= 4 then o.i::int end), f.ema * (1 - 0.1::double) + o.v * 0.1::double from f join o on o.event_type = f.event_type and o.i = f.i + 1)
select event_type, max(i)::int as evaluations, max(stop) as stopped_at, round(max_by(ema, i), 6) as smoothed from f group by 1""",
    "source_report": f"""with recursive {_windows_sql(_SPLITS, "splits")}, raws as (select source, count(*) as documents, sum(coalesce(length(text), 0))::bigint as chars from documents group by 1),
xs as (select s.*, s.doc_id = s.canonical_id as own, s.text = c.text as same from splits s join splits c on c.doc_id = s.canonical_id),
kepts as (select source, count(*) as accepted, sum(n) as clean_chars, sum(own::int) as canonical, sum(case when own then n else 0 end) as unique_chars, sum((not own and same)::int) as exact_duplicates, sum((not own and not same)::int) as near_duplicates,
  sum(greatest(n - {SIZE}, 0)) as recovered_tokens, sum((split = 'train')::int) as train, sum((split = 'validation')::int) as validation, sum((split = 'diagnostic')::int) as diagnostic from xs group by 1),
g as (select source, count(*) as segments, sum(new_tokens + eos) as loss_tokens, sum(end_token - start_token + bos + eos) as input_tokens from w group by 1)
select r.source, documents, chars, coalesce(accepted, 0)::bigint as accepted, coalesce(clean_chars, 0)::bigint as clean_chars, coalesce(canonical, 0)::bigint as canonical, coalesce(unique_chars, 0)::bigint as unique_chars, coalesce(exact_duplicates, 0)::bigint as exact_duplicates,
coalesce(near_duplicates, 0)::bigint as near_duplicates, coalesce(segments, 0)::bigint as segments, coalesce(loss_tokens, 0)::bigint as loss_tokens, coalesce(input_tokens, 0)::bigint as input_tokens, coalesce(recovered_tokens, 0)::bigint as recovered_tokens,
coalesce(train, 0)::bigint as train, coalesce(validation, 0)::bigint as validation, coalesce(diagnostic, 0)::bigint as diagnostic from raws r left join kepts using (source) left join g using (source)""",
}
