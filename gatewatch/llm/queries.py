"""The registered query of each operator, with production settings, over its whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm.filter_audit import audit_filters
from gatewatch.llm.licences import scan_licences
from gatewatch.llm.lm import deleted_interpolation
from gatewatch.llm.mixing import mix_sources
from gatewatch.llm.near_dups import near_duplicates
from gatewatch.llm.neighbour_links import link_neighbours
from gatewatch.llm.periodic import periodic_runs
from gatewatch.llm.pieces import encode_pieces
from gatewatch.llm.preferences import format_preferences
from gatewatch.llm.quality_classifier import fit_quality, score_quality
from gatewatch.llm.quality_rules import let, quality_rules, words_of
from gatewatch.llm.secret_scan import scan_secrets
from gatewatch.llm.staging import staged, table
from gatewatch.llm.warc import assemble, read_warc, write_warc
from gatewatch.session import scratch_dir

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query
def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn = fold() % 5 != 1
    scores = deleted_interpolation(docs, learn, F.floor(fold() / 5) % 10 == 0, order=3)
    held_out = F.coalesce(fold() % 5 == 1, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def trusted_ids(spark, sf_dir):
    """Documents that the label table calls good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


@query
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted_ids(spark, sf_dir), with_text=False)


QUALITY_CUT = 0.3


def quality_model(spark, docs, sf_dir):
    """Fitted on the labelled rows whose id's checksum is not 0 modulo 5; a quarter of those calibrate."""
    return fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), fold() % 5 != 0, F.floor(fold() / 5) % 4 == 0)


@query
def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = score_quality(docs, quality_model(spark, docs, sf_dir), drop=("text",))
    held_out = F.coalesce(fold() % 5 == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@query
def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


MIX_WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op3_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE)


@query
def op4_sentence_pieces(spark, sf_dir):
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL, drop=("text",))


@query
def op2_neighbour_links(spark, sf_dir):
    return link_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op7_warc_captures(spark, sf_dir):
    path = scratch_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = assemble(staged(read_warc(spark, path, with_payload=False), "records"))
    rows = captures.select(F.col("metadata.fields")["id"].cast("long").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
                           F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.record_type").alias("record_type"),
                           F.col("refers_to.fields")["id"].cast("long").alias("refers_to"), F.col("metadata.fields")["copies"].cast("long").alias("copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "_copy")


ORACLE["op7_warc_captures"] = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select h, min(page_id) as first_id from p where n >= 100 group by h)
select p.page_id, cast(p.n as bigint) as payload_bytes, sha256(p.h) as payload_digest,
  case when first_id <> p.page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> p.page_id then first_id end as refers_to
from p left join f using (h)
"""


@query
def op5_licence_scan(spark, sf_dir):
    """A directory per source, language and thousand ids; every tenth document is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", (F.expr("doc_id div 1000")).cast("string"), name)
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"), id_col="doc_id")


@query
def op9_preference_pairs(spark, sf_dir):
    """Each conversation is chosen over a twin whose last reply is that of the neighbouring conversation (ids 2k and 2k + 1)."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.*")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    ends = last.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("at"))
    kept = chosen.join(ends, "pair_id", "left").where("at is null or turn < at").drop("at")
    partner = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1)
    reply = last.select(partner.alias("pair_id"), "text").join(ends, "pair_id").select("pair_id", F.col("at").alias("turn"), F.lit("assistant").alias("role"), "text")
    pairs = format_preferences(chosen, kept.unionByName(reply))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


ORACLE["op9_preference_pairs"] = """
with t as (select conv_id as pair_id, turn, role, text from conversations),
last as (select conv_id, max(turn) as place, arg_max(text, turn) as text from conversations where role = 'assistant' group by 1),
rej as (select t.pair_id, turn, role, t.text from t left join last on conv_id = pair_id where place is null or turn < place
  union all select o.conv_id, o.place, 'assistant', p.text from last o join last p on p.conv_id = case when o.conv_id % 2 = 0 then o.conv_id + 1 else o.conv_id - 1 end),
both_sides as (select 'c' as side, * from t union all select 'r', * from rej),
n as (select *, row_number() over (partition by side, pair_id order by turn nulls first, role nulls first, text nulls first) as i from both_sides),
cnt as (select pair_id, count(*) filter (where side = 'c') as c, count(*) filter (where side = 'r') as r from n group by 1),
mis as (select a.pair_id, min(a.i) as i from n a join n b on a.pair_id = b.pair_id and a.i = b.i and a.side = 'c' and b.side = 'r'
  where a.role is distinct from b.role or a.text is distinct from b.text group by 1),
k as (select cnt.pair_id, coalesce(mis.i - 1, least(c, r)) as k from cnt left join mis on cnt.pair_id = mis.pair_id),
m as (select n.*, k, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) as o, coalesce(text, '') || '<|end|>' || chr(10) as b from n join k on n.pair_id = k.pair_id),
p as (select *, coalesce(sum(length(o) + length(b)) over (partition by side, pair_id, i > k order by i rows between unbounded preceding and 1 preceding), 0) as place from m)
select pair_id, cast(k as integer) as n_prompt_turns,
  coalesce(string_agg(o || b, '' order by i) filter (where side = 'c' and i <= k), '') as prompt,
  coalesce(string_agg(o || b, '' order by i) filter (where side = 'c' and i > k), '') as chosen,
  coalesce(string_agg(o || b, '' order by i) filter (where side = 'r' and i > k), '') as rejected,
  coalesce(string_agg((place + length(o)) || '-' || (place + length(o) + length(b)), ',' order by i) filter (where side = 'c' and i > k and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg((place + length(o)) || '-' || (place + length(o) + length(b)), ',' order by i) filter (where side = 'r' and i > k and role = 'assistant'), '') as rejected_spans
from p group by pair_id, k
"""


def _with_planted_run(docs):
    """The contract's input: the text of every tenth id, by checksum, repeats itself from some word on."""
    h = fold()
    g = F.floor(h / 10)

    def changed(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: words[place(i)]), " ")

    words = words_of(F.col("text"))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, changed(w)))).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(_with_planted_run(table(spark, sf_dir, "documents")), drop=("text",))
    # Largest length, then smallest start, then smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = found.withColumn("_best", best).withColumn("_lines", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
                       (-F.col("_best.period")).alias("period"), F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
                       F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op13_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_filter_audit"] = r"""
with letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (select filter_order, step, letter, bit, coalesce((select sum(x.bit) from letters x where instr(filter_order, x.letter) < step), 0) as earlier
  from orders, range(1, 6) r(step), letters where substr(filter_order, step, 1) = letter),
l as (select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as toxic from labels where doc_id is not null group by 1),
d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
  + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
  + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask from d),
c as (select part, mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n from f left join l using (doc_id) group by all),
s as (select part, filter_order, step, letter,
  sum(case when mask & (earlier + bit) = 0 then n else 0 end) as kept,
  sum(case when mask & earlier = 0 and mask & bit > 0 then n else 0 end) as removed,
  sum(case when mask & earlier > 0 and mask & bit > 0 then n else 0 end) as redundant,
  sum(case when mask = bit then n else 0 end) as unique_fails,
  sum(case when mask & earlier = 0 and mask & bit > 0 then n * good else 0 end) as good_lost,
  sum(case when mask & earlier = 0 and mask & bit > 0 then n * toxic else 0 end) as toxic_lost
  from c, steps group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from s
"""
