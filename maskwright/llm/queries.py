"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import (
    chat, decontaminate, langid, line_dedup, merkle, mixing, ngram_lm, quality, simhash, token_counts, toxicity, vectors,
    whitening,
)
from maskwright.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: shingles of four words, links at four bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query(
    "op10_backoff_scores",
    r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(generate_series(1, len(ws))) as i from t),
g as (select doc_id, i, ws[i] as c, case when i > 1 then ws[i - 1] end as b, case when i > 2 then ws[i - 2] end as a from p),
c1 as (select c, count(*) as n from g group by c),
c2 as (select b, c, count(*) as n from g where i > 1 group by b, c),
c3 as (select a, b, c, count(*) as n from g where i > 2 group by a, b, c),
s as (
  select g.doc_id, case
    when i > 2 and c3.n >= 2 then ln(c3.n / ab.n)
    when i > 1 and c2.n >= 2 then ln(c2.n / cb.n) + case when i > 2 then ln(0.4) else 0 end
    else ln(c1.n / (select count(*) from g)) + (least(i, 3) - 1) * ln(0.4) end as x
  from g join c1 on g.c = c1.c left join c1 as cb on g.b = cb.c
  left join c2 on g.b = c2.b and g.c = c2.c left join c2 as ab on g.a = ab.b and g.b = ab.c
  left join c3 on g.a = c3.a and g.b = c3.b and g.c = c3.c),
d as (select doc_id, count(*) as n, sum(x) as x from s group by doc_id)
select t.doc_id, coalesce(n, 0) as n_words, round(coalesce(x, 0), 3) as log_score, round(x / n, 6) as mean_log_score
from t left join d using (doc_id)""",
)
def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents from trigram, bigram and word counts of all."""
    found = ngram_lm.backoff_scores(table(spark, sf_dir, "documents"), order=3, min_count=2, backoff=0.4)
    return found.select(
        "doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a network trained on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op5_vectors")
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all embeddings of equal label at a cosine of 0.98 or more."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query(
    "op8_decontaminate",
    r"""
with b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from benchmark),
i as (select item_id, w, len(w) as n, len(w) - len(w) // 4 as cut from b where len(w) >= 5),
g as (
  select item_id, n, cut, unnest(generate_series(1, n - 4)) as k, w from i),
s as (
  select distinct item_id, array_to_string(w[k:k + 4], ' ') as s, p from
  (select *, unnest(['all', case when k <= greatest(cut - 4, 1) then 'question' end, case when k >= least(cut + 1, n - 4) then 'answer' end]) as p from g)
  where p is not null),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
t as (
  select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as k from d where len(w) >= 5)),
hit as (select doc_id, item_id, p, count(*) as n from s join t using (s) group by all),
total as (select item_id, p, count(*) as n from s group by all),
share as (select hit.doc_id, hit.item_id, hit.p, hit.n / total.n as x from hit join total using (item_id, p))
select doc_id, item_id, max(x) filter (where p = 'question') as question_overlap, max(x) filter (where p = 'answer') as answer_overlap
from share group by doc_id, item_id
having max(x) filter (where p = 'all') >= 0.8 and max(x) filter (where p = 'question') >= 0.5 and max(x) filter (where p = 'answer') >= 0.5""",
)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item whose text stands in it."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "question_overlap", "answer_overlap")


@query(
    "op1_line_dedup",
    """
with d as (select doc_id, coalesce(text, '') as text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(generate_series(1, len(ls))) as i from d),
n as (select doc_id, line, i, row_number() over (partition by doc_id order by i) as r from l where trim(line) <> ''),
w as (
  select a.doc_id, a.r, a.line || chr(10) || b.line || chr(10) || c.line as w
  from n a join n b on a.doc_id = b.doc_id and b.r = a.r + 1 join n c on a.doc_id = c.doc_id and c.r = a.r + 2),
f as (select doc_id, r, row_number() over (partition by w order by doc_id, r) as k from w),
g as (select distinct doc_id, r + s as r from f, (select unnest([0, 1, 2]) as s) where k > 1),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text
  from l left join n on l.doc_id = n.doc_id and l.i = n.i left join g on l.doc_id = g.doc_id and n.r = g.r
  where g.r is null group by l.doc_id),
c as (select doc_id, count(*) as k from g group by doc_id)
select d.doc_id, coalesce(kept.text, '') as text, len(d.ls) as n_lines, coalesce(c.k, 0) as n_removed
from d left join kept using (doc_id) left join c using (doc_id)""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents without repeated three-line windows."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


@query(
    "op6_mix",
    r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('17:' || cast(doc_id as varchar)), 1, 15))::bigint as draw from documents),
s as (select source, sum(size) as n, row_number() over (order by source nulls last) as k from d group by source),
w as (select source, n, case k % 3 when 1 then 5.0 when 2 then 2.0 else 1.0 end as w from s),
r as (
  select source, n, w, 2.0 * n / w as r, 1.5 * sum(n) over () - sum(2.0 * n) over (order by 2.0 * n / w, source) + 2.0 * n as left_over,
    sum(w) over () - sum(w) over (order by 2.0 * n / w, source) + w as w_left from w),
level as (select max(left_over / w_left) as x from r),
t as (select source, n, least(2.0 * n, w * x) as target from r, level),
c as (
  select doc_id, size, n, target, cast(floor(target + 0.5) as bigint) as q,
    sum(size) over (partition by d.source order by draw, doc_id, size rows unbounded preceding) - size as pos
  from d join t on d.source is not distinct from t.source)
select doc_id, size, cast(n as bigint) as source_size, round(target, 6) as target,
  cast(size * (cast(2 * pos + size < 2 * q as int) + cast(2 * (pos + n) + size < 2 * q as int)) as bigint) as taken
from c""",
)
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents: sources weigh 5, 2, 1 in turn and share 150 % of all words."""
    found = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"), repeats=2, share=1.5, weights=(5.0, 2.0, 1.0))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")

CHAT_EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query(
    "op3_chat",
    r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '\[/?SYS\]|\[/?INST\]|</?s>|\[ROLE\]|\[/?TEXT\]'))
    + cast(regexp_matches(text, '(<|</|<s|</s|\[|\[/|\[S|\[SY|\[SYS|\[/S|\[/SY|\[/SYS|\[I|\[IN|\[INS|\[INST|\[/I|\[/IN|\[/INS|\[/INST|\[R|\[RO|\[ROL|\[ROLE|\[T|\[TE|\[TEX|\[TEXT|\[/T|\[/TE|\[/TEX|\[/TEXT)$') as int)
    + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7 else 19 + length(role) end as chars
  from c),
o as (
  select *, coalesce(case lag(role) over (partition by conv_id order by turn, role, text)
    when 'system' then role = 'user' when 'user' then role = 'assistant' when 'assistant' then role = 'user'
    else role in ('system', 'user') and lag(role) over (partition by conv_id order by turn, role, text) is null end, false) as fine from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, bool_and(fine) as in_order
from o group by conv_id""",
)
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds control strings, read from their formatted text."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CHAT_EXTRA, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_turns(own.unionByName(extra)))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a scorer trained on weak labels."""
    return quality.score_quality(table(spark, sf_dir, "documents"))


#: The tokenizer of ``op11_token_counts``: a file of the package of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, and whether they have more than 1,024 tokens."""
    import public_tokenizers

    tokenizer = token_counts.read_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer, limit=1024)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 leading components of their distinct integer vectors, whitened."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), k=16)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text")]
    return f"sha256({' || '.join(parts)})"


# CRC-32 of a short text, byte by byte and bit by bit.
_CRC_SQL = """(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, 1 + length({0})), lambda i: ascii(substr({0}, i, 1))::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""


@query(
    "op12_merkle",
    f"""
with recursive d as (
  select doc_id, lang, {_leaf_sql("n_chars")} as leaf,
    case when xor({_CRC_SQL.format("doc_id::varchar")}, 4294967295) % 7 = 0 then {_leaf_sql("n_chars + 1")} end as changed
  from documents),
l as (
  select *, count(*) over (partition by lang) as n, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d),
up as (
  select lang, 0 as lvl, pos, n, leaf as h from l
  union all
  select lang, lvl + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by pos)) from up where n > 1 group by lang, lvl, pos // 2),
sub as (
  select lang, h, lvl as height, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
top as (
  select 0 as lvl, pos, n, h from sub
  union all
  select lvl + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lvl, pos // 2),
path as (
  select l.doc_id, l.leaf, up.lvl, (l.pos >> up.lvl) % 2 = 1 as is_right, s.h as sibling, l.changed
  from l join up on l.lang is not distinct from up.lang and l.pos >> up.lvl = up.pos and up.n > 1
  left join up as s on s.lang is not distinct from l.lang and s.lvl = up.lvl and s.pos = xor(up.pos, 1)
  union all
  select l.doc_id, l.leaf, sub.height + top.lvl, (sub.pos >> top.lvl) % 2 = 1, s.h, l.changed
  from l join sub on l.lang is not distinct from sub.lang join top on sub.pos >> top.lvl = top.pos and top.n > 1
  left join top as s on s.lvl = top.lvl and s.pos = xor(top.pos, 1)),
proof as (
  select doc_id, leaf, coalesce(changed, leaf) as h, coalesce(string_agg(sibling, '' order by lvl), '') as p,
    list(struct_pack(r := is_right, s := coalesce(sibling, '')) order by lvl) as steps
  from path group by doc_id, leaf, changed),
folding as (
  select doc_id, leaf, 1 as k, h, steps from proof
  union all
  select doc_id, leaf, k + 1, sha256(case when steps[k].r then steps[k].s || h else h || steps[k].s end), steps from folding where k <= len(steps)),
done as (select doc_id, leaf, h from folding where k = len(steps) + 1)
select proof.doc_id, proof.leaf, sub.h as subroot, (select h from top where n = 1) as root, sha256(proof.p) as proof_sha256,
  done.h as folded_root, done.h = (select h from top where n = 1) as verified
from proof join done on proof.doc_id = done.doc_id join l on l.doc_id = proof.doc_id join sub on l.lang is not distinct from sub.lang""",
)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents; every seventh by CRC-32 of its id is folded with one character too many."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(docs, altered={"n_chars": tampered})
