"""The queries of the operators in this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as D
from . import language_id as L
from . import line_dedup as N
from . import mixing as M
from . import quality_classifier as C
from . import quality_rules as R
from . import simhash as S
from . import substring_dedup as U
from . import suffix_dedup as X
from . import token_counts as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        D.items_digest(F.col("items")).alias("items_sha256"),
        D.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return T.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.identify(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.suffix_dedup(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.substring_dedup(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_rules(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mixing_to_target_weights": op10_mixing_to_target_weights,
}

SQL = {
    "op1_benchmark_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') w from benchmark where text is not null),
iw as (select distinct item_id, least(13, len(w)) n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') g from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) where len(w) > 0),
sizes as (select distinct n from iw),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g from d, sizes, unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n),
m as (select dw.doc_id, dw.i, dw.n, iw.item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from m)) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
from d left join h using (doc_id) left join it using (doc_id)
""",
    "op8_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
ln as (select doc_id, i, l, list_sum(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: length(x))) c
  from (select doc_id, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
dl as (select doc_id, count(*) n_dup_lines, sum(c) dup_line_chars from (select doc_id, c, row_number() over (partition by doc_id, l order by i) r from ln) where r > 1 group by doc_id),
g as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') s from d, (values (3), (5), (7), (10)) z(n), unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n),
r as (select doc_id, n, i from (select doc_id, n, i, count(*) over (partition by doc_id, n, s) k from g) where k > 1),
p as (select distinct doc_id, n, unnest(range(i, i + n)) q from r),
c as (select p.doc_id, p.n, count(*) k, sum(length(d.w[p.q])) ch from p join d using (doc_id) group by all),
a as (select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines,
    cast(coalesce(c3.k, 0) as bigint) n_repeat_words, cast(coalesce(dup_line_chars, 0) as bigint) dup_line_chars,
    cast(coalesce(c5.ch, 0) as bigint) dup_5gram_chars, cast(coalesce(c7.ch, 0) as bigint) dup_7gram_chars, cast(coalesce(c10.ch, 0) as bigint) dup_10gram_chars
  from d left join dl using (doc_id) left join c c3 on c3.doc_id = d.doc_id and c3.n = 3 left join c c5 on c5.doc_id = d.doc_id and c5.n = 5
  left join c c7 on c7.doc_id = d.doc_id and c7.n = 7 left join c c10 on c10.doc_id = d.doc_id and c10.n = 10),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from a)
select *, not base_failed and not (dup_line_chars > 0.30 * word_chars or dup_5gram_chars > 0.35 * word_chars or dup_7gram_chars > 0.32 * word_chars or dup_10gram_chars > 0.30 * word_chars) kept from f
""",
    "op10_mixing_to_target_weights": r"""
with s as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size, md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) key from documents),
t as (select source, sum(size)::bigint source_size from s group by source),
k as (select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double weight, 2.0::double * source_size bound from t),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(bound) over (order by bound / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by bound / weight, source nulls last rows between current row and unbounded following) lev from k),
c as (select arg_min(lev, bound / weight) filter (bound > weight * lev) com from l),
g as (select source, source_size, case when bound <= weight * lev then bound else weight * com end target from l, c),
o as (select s.doc_id, s.size, g.source_size, g.target, cast(round(g.target) as bigint) budget,
  coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) start
  from s join g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else
  (budget // source_size) * size + least(greatest(budget - (budget // source_size) * source_size - start, 0), size) end as bigint) taken from o
""",
    "op5_suffix_array_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
g as (select doc_id, i, md5(substring(x, 2 * i - 1, 200)) s from d, unnest(range(1, len(x) // 2 - 98)) t(i) where len(x) >= 200),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from g) where k > 1),
e as (select doc_id, i, case when i > lag(i) over w + 100 or lag(i) over w is null then 1 else 0 end new from r window w as (partition by doc_id order by i)),
u as (select doc_id, n, min(i) lo, max(i) + 100 hi from (select doc_id, i, sum(new) over (partition by doc_id order by i) n from e) group by doc_id, n),
b as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 1) before from u),
k as (select b.doc_id, string_agg(substring(x, 2 * before - 1, 2 * (lo - before)), '' order by lo) || substring(any_value(x), 2 * max(hi) - 1) x, sum(hi - lo) n_removed, count(*) n_spans from b join d using (doc_id) group by b.doc_id)
select d.doc_id, cast(len(d.x) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(k.x, d.x))) kept_sha256
from d left join k using (doc_id)
""",
    "op6_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) s from d, unnest(range(1, len(w) - 33)) t(i) where len(w) >= 35),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) k from g) where k > 1),
p as (select doc_id, list(distinct q) ps from (select doc_id, unnest(range(i, i + 35)) q from r) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(ps), 0) as bigint) n_removed,
  sha256(coalesce(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' '), '')) kept_sha256
from d left join p using (doc_id)
""",
}
