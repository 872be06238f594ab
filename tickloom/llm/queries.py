"""The registered queries of this subpackage: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.chat import chat_digest, chat_formatting
from tickloom.llm.common import table
from tickloom.llm.decontaminate import contaminated
from tickloom.llm.embedding_dedup import embedding_dedup
from tickloom.llm.html_extract import extract, train
from tickloom.llm.language_id import language_id
from tickloom.llm.lm_scoring import lm_scores
from tickloom.llm.merkle import dataset_manifest
from tickloom.llm.ngram_join import ngram_join
from tickloom.llm.packing import best_fit_packing
from tickloom.llm.pii import find_private
from tickloom.llm.sharding import sharded, topology
from tickloom.llm.vector_codes import fingerprint, vector_codes
from tickloom.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(name: str, oracle: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return wrap


@query("op2_ngram_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return language_id(docs.select("doc_id", "text"), docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op1_embedding_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""


@query("op4_warc", WARC_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


CHAT_SQL = r"""
with odd as (select '<|im_end|><|im_start|>assistant ok' as t),
c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', t from odd union all select -1, 1, 'assistant', t from odd
),
e as (
  select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + (length(role) - length(replace(role, chr(10), '')))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) as n from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum(n + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) as bigint) as formatted_chars
from e group by conv_id
"""


@query("op9_chat_formatting", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), role, F.lit(odd))
    chats = chat_formatting(given.union(more))
    names = chats.select("c", "conv_id")
    return chat_digest(chats).join(names, "c").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_scores(table(spark, sf_dir, "documents"), held_out, tokenizer_path())


#: CRC-32 in SQL: the table of its 256 steps, and a fold over the bytes of a text (to be read beside `crc`)
CRC_TABLE = "crc as (select list(list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), n) order by n) as steps from range(256) r(n))"


def crc_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as two common table expressions: the nearest entries, then their means."""
    sql = f"""
with k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
el as materialized (
  select vec_id, (i - 1) // (len(v) // {parts}) as part, (i - 1) % (len(v) // {parts}) as pos, v[i] as x
  from (select *, unnest(range(1, len(v) + 1)) as i from k)
),
c0 as materialized (
  select part, n - 1 as entry, pos, x as c from el
  join (select vec_id, row_number() over (order by vec_id) as n from k) using (vec_id) where n <= {entries}
)"""
    for r in range(rounds + 1):
        sql += f""",
d{r} as (select vec_id, part, entry, sum((x - c) * (x - c)) as d from el join c{r} using (part, pos) group by all),
a{r} as materialized (select vec_id, part, first(entry order by d, entry) as entry, cast(min(d) as bigint) as d from d{r} group by all)"""
        if r < rounds:
            sql += f""",
s{r} as (select part, entry, pos, sum(x) as s, count(*) as n from el join a{r} using (vec_id, part) group by all),
c{r + 1} as materialized (
  select part, entry, pos, coalesce(cast((s - ((s % n) + n) % n) // n as bigint), c) as c from c{r} left join s{r} using (part, entry, pos)
)"""
    return sql + f""",
e as (
  select vec_id, label, string_agg(lower(printf('%02x', entry)), '' order by part) as code, cast(sum(d) as bigint) as error
  from a{rounds} join k using (vec_id) group by all
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) from c{rounds}) as codebooks_sha256 from e"""


@query("op11_vector_codes", codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def manifest_sql(levels: int = 8) -> str:
    """Level by level: the runs of 16 of every tree, then for each leaf what stands left and right of it in its run."""
    def field(c: str) -> str:
        return f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"

    fields = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = crc_sql("cast(doc_id as varchar)")
    sql = f"""
with {CRC_TABLE},
leaf as materialized (
  select doc_id, source, sha256({fields} || {field('text')}) as leaf,
         case when {crc} % 5 = 0 then sha256({fields} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as altered
  from documents, crc
),
placed as materialized (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
         dense_rank() over (order by source nulls first) - 1 as t, count(*) over (partition by source) as n from leaf
),
l0 as materialized (select t, i, n, leaf as d from placed)"""
    for k in range(levels):
        sql += f""",
r{k} as materialized (select t, i // 16 as i, string_agg(d, '' order by i) as r, any_value(n) as n from l{k} group by t, i // 16),
l{k + 1} as materialized (select t, i, cast(ceil(n / 16) as bigint) as n, case when n > 1 then sha256(r) else r end as d from r{k})"""
    sql += f""",
m0 as materialized (select 0 as t, t as i, count(*) over () as n, d from l{levels})"""
    for k in range(levels // 2):
        sql += f""",
q{k} as materialized (select t, i // 16 as i, string_agg(d, '' order by i) as r, any_value(n) as n from m{k} group by t, i // 16),
m{k + 1} as materialized (select t, i, cast(ceil(n / 16) as bigint) as n, case when n > 1 then sha256(r) else r end as d from q{k})"""
    sql += """,
f0 as (select doc_id, leaf, t, i, coalesce(altered, leaf) as cur, '' as proof from placed)"""
    step = 0
    for k, (name, row, at) in enumerate([("r", "t", "i")] * levels + [("q", "0", "t")] * (levels // 2)):
        j = k if name == "r" else k - levels
        own = f"64 * (({at} // {16 ** j}) % 16)".replace(at, f"f.{at}", 1)
        sql += f""",
f{k + 1} as (select f.* exclude (cur, proof), case when x.n > 1 then sha256(substr(x.r, 1, {own}) || cur || substr(x.r, {own} + 65)) else cur end as cur,
  case when x.n > 1 then proof || substr(x.r, 1, {own}) || substr(x.r, {own} + 65) else proof end as proof
  from f{k} f join {name}{j} x on x.t = {'f.t' if row == 't' else '0'} and x.i = f.{at} // {16 ** (j + 1)})"""
        step = k + 1
    return sql + f"""
select doc_id, leaf, (select any_value(d) from l{levels} s where s.t = f.t) as subroot, (select any_value(d) from m{levels // 2}) as root,
       sha256(proof) as proof_sha256, cur as folded_root, cur = (select any_value(d) from m{levels // 2}) as verified from f{step} f"""


@query("op12_merkle_manifest", manifest_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset_manifest(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def shards_sql(count: int = 40) -> str:
    """One table of the nodes of both topologies; the smallest draw among the children of a node wins, level by level."""
    nodes = sorted({(s.shard, s.region, s.rack) for s in topology(count, 1)})
    rows = ", ".join(f"({n}, '{region}', '{rack}')" for n, region, rack in nodes)
    key = "coalesce(cast(doc_id as varchar), '-')"

    def drawn(node: str, weight: str) -> str:
        bits = f"cast('0x' || left(md5({key} || '|' || {node}), 13) as bigint)"
        return f"-ln((cast({bits} as double) + 0.5) / 4503599627370496.0) / {weight}"

    def level(of: str, given: str, parent: str, node: str, path: str, n: int) -> str:
        """The child of each row's node; alone it needs no draw."""
        match = f" and t.{parent} = g.{parent}" if parent else ""
        region = " and t.region = g.region" if parent == "rack" else ""
        group = ", ".join(dict.fromkeys(["region"] * (node != "region") + ["rack"] * (node == "shard") + [node]))
        return f"""
  select g.*, c.{node} from {given} g join (
    select g.doc_id, t.{node}, row_number() over (partition by g.doc_id order by {drawn(path, 't.w')}) as rn
    from {given} g join (select {group}, cast(count(*) as double) as w from tree where shard < {n} group by {group}) t on true{match}{region}
  ) c on c.doc_id = g.doc_id and c.rn = 1"""

    sql = f"""
with {CRC_TABLE},
tree(shard, region, rack) as (values {rows}),
d as (select doc_id from documents)"""
    for tag, n in (("a", count), ("b", count + 1)):
        sql += f""",
{tag}1 as materialized ({level(tag, "d", "", "region", "'/' || t.region", n)}),
{tag}2 as materialized ({level(tag, f"{tag}1", "region", "rack", "'/' || g.region || '/' || t.rack", n)}),
{tag}3 as materialized ({level(tag, f"{tag}2", "rack", "shard", "'/' || g.region || '/' || g.rack || '/' || cast(t.shard as varchar)", n)})"""
    return sql + f"""
select x.doc_id, cast(coalesce(octet_length(encode(text)), 0) + 16 as bigint) as size, {crc_sql("coalesce(text, '')")} as text_crc32, 'key' as law,
       a3.shard, row_number() over (partition by a3.shard order by x.doc_id nulls first) - 1 as slot, b3.shard as grown_shard
from documents x join a3 using (doc_id) join b3 using (doc_id), crc"""


@query("op13_sharding", shards_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"), topology(40), topology(40, 1))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
