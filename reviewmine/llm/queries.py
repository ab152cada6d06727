"""The registered queries of the operators, with SQL where SQL can express them.

Every query runs its operator over its whole tables, with the parameters meant
for production, and returns one row per document, page or conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmine.llm import (
    bpe,
    chat,
    decontaminate,
    html_text,
    langid,
    line_rules,
    merkle,
    mixing_lm,
    rule_quality,
    secrets,
    simhash,
    token_counts,
    vector_codes,
)
from reviewmine.llm.batches import held_out, remainder
from reviewmine.sources.shared import attach


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", *more)


def _doc_id():
    return F.col("row.doc_id").alias("doc_id")


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learned from three quarters of the labelled documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out("doc_id", 4))
    model = langid.train(docs.where(~F.col("held_out")))
    found = langid.predict(docs, model, carry=["doc_id", "held_out"])
    return found.select(_doc_id(), "row.held_out", "out.lang_pred", "out.score")


def op2_rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every text, learned from three quarters of the labelled documents."""
    docs = documents(spark, folder).withColumn("held_out", held_out("doc_id", 4))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = rule_quality.train(docs.where(~F.col("held_out")), labels)
    found = rule_quality.predict(docs, model, carry=["doc_id", "held_out"])
    predicted = (F.col("score") >= rule_quality.PASSED).cast("int")
    return found.select(_doc_id(), "row.held_out", "score", predicted.alias("predicted"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages, carry=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations formatted, and what is read back from the output."""
    said = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    done = chat.format_conversations(chat.turns(rows))
    back = done.select("conv_id", "valid", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                       chat.learned_text(F.col("segments")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


OP4_SQL = r"""with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (
  select *, lag(role, 1, 'start') over (partition by conv_id order by turn, role, text) as before,
         length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) as size
  from rows),
whole as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
         sum(size + length('### : </turn>') + 1) as formatted,
         bool_and((before, role) in (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) as ok,
         last(role order by turn, role, text) as final
  from marked group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256,
       cast(formatted as bigint) as formatted_chars, ok and final in ('assistant', 'user') as valid
from whole"""


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint and the linked group of every document."""
    found = simhash.linked(documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they are from."""
    found = decontaminate.scan(documents(spark, folder), table(spark, folder, "benchmark"), carry=["doc_id"])
    items = F.array_join(F.array_sort(F.transform("out.items", lambda i: i.cast("string"))), ",")
    return found.select(
        _doc_id(),
        "out.n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("out.items").cast("bigint").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.size("out.spans") > 0).alias("contaminated"),
    )


OP6_SQL = r"""with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bl as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
bg as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from bl)),
dg as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bg) where len(w) >= n)),
hit as (select doc_id, i, dg.n, item_id from dg join bg on dg.gram = bg.gram and dg.n = bg.n),
counted as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from hit) group by 1),
named as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, cast(item_id as varchar) as name from hit) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join counted using (doc_id) left join named using (doc_id)"""


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text, and the text decoded from them, as counts and digests."""
    return bpe.round_trip(documents(spark, folder), carry=["doc_id"]).select(_doc_id(), "out.*")


def op8_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and verdicts; the words in lines that recur on the host are in ``n_cut_words``."""
    found = line_rules.judge(documents(spark, folder, "source"), carry=["doc_id"])
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(_doc_id(), *(f"out.{n}" for n in base), "base_failed", "kept", F.col("cut").alias("n_cut_words"))


OP8_SQL = r"""with d as (
  select doc_id, coalesce(source, '') as source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
lines as (
  select doc_id, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as lw
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from d)),
own as (select doc_id, source, text, line, array_to_string(lw, ' ') as l, len(lw) as n from lines where len(lw) > 0),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from own group by 1),
hosts as (select source, count(distinct text) as texts from d group by 1),
often as (
  select source, l from (select source, l, count(distinct text) as n from own group by 1, 2) join hosts using (source)
  where n >= 10 and n >= least(50, 0.005 * texts)),
cut as (select doc_id, sum(n) as n_cut_words from own join often using (source, l) group by 1),
grams as (
  select doc_id, i, array_to_string(w[i : i + 4], ' ') as gram
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from grams) where n > 1),
rep as (select doc_id, count(distinct place) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as place from again) group by 1),
base as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_cut_words, 0) as n_cut_words
  from d left join dup using (doc_id) left join rep using (doc_id) left join cut using (doc_id)),
failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - n_cut_words >= 0.3 * n_words as kept, cast(n_cut_words as bigint) as n_cut_words
from failed"""

def op9_mixing_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every text, learned from six sevenths of the documents."""
    docs = documents(spark, folder).withColumn("held_out", held_out("doc_id", 7))
    found = mixing_lm.score(docs, docs.where(~F.col("held_out")), carry=["doc_id", "held_out"])
    return found.select(_doc_id(), "row.held_out", *found.columns[1:])


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text under a unigram tokenizer, and their summed scores."""
    return token_counts.count_tokens(documents(spark, folder), carry=["doc_id"]).select(_doc_id(), "out.*")


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text: the given kinds counted and digested, and the spans of all rules."""
    spans = F.col("out.spans")
    base = [rule.kind for rule in secrets.RULES[:3]]
    return secrets.scan(documents(spark, folder), carry=["doc_id"]).select(
        _doc_id(),
        *(secrets.count(spans, kind).alias(f"n_{kind}") for kind in base),
        F.sha2(secrets.told(spans, base), 256).alias("base_sha256"),
        secrets.told(spans).alias("spans"),
    )


def _rule_sql(number: int, rule: secrets.Rule) -> str:
    """Matches as they are cut out of the text: a match starts where all earlier pieces and matches end."""
    pattern = rule.pattern.replace("'", "''")
    counted = "m" if rule.group == 0 else f"regexp_extract_all(text, '{pattern}', {rule.group})"
    return f"""select doc_id, {number} as number, '{rule.kind}' as kind, m[i] as match, {'c[i]' if rule.group else 'm[i]'} as counted,
      list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) as first
      from (select doc_id, m, p, c, unnest(range(1, len(m) + 1)) as i from (
        select doc_id, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as p, {counted} as c from d))
      where length({'c[i]' if rule.group else 'm[i]'}) >= {rule.least}"""


OP11_SQL = f"""with d as (select doc_id, coalesce(text, '') as text from documents),
found as ({' union all '.join(_rule_sql(i, rule) for i, rule in enumerate(secrets.RULES))}),
told as (
  select doc_id, number, kind, cast(first as bigint) as first,
         concat(kind, ':', cast(first as bigint), ':', cast(first as bigint) + length(match)) as span from found),
whole as (
  select doc_id, count(*) filter (number = 0) as n_assign, count(*) filter (number = 1) as n_access, count(*) filter (number = 2) as n_hex,
         string_agg(span, ',' order by first, number) filter (number < 3) as base, string_agg(span, ',' order by first, number) as spans
  from told group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join whole using (doc_id)"""


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every vector, and the error it leaves."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    found, books = vector_codes.compress(vectors)
    return vector_codes.with_group_error(found, "label").select(
        "row.vec_id",
        "code",
        "error",
        F.col("group_error").alias("label_error"),
        F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"),
    )


def _round_sql(i: int) -> str:
    """Assign all parts to the entries of round i, and move these."""
    return f"""a{i} as materialized (
  select p.part, p.vec_id, p.v, min(struct_pack(d := list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), k := b.k)) as best
  from parts p join b{i} b using (part) group by all),
m{i} as (
  select part, k, list(cast(floor(s / n) as double) order by pos) as v from (
    select part, k, pos, sum(x) as s, count(*) as n
    from (select part, best.k as k, unnest(v) as x, unnest(range(len(v))) as pos from a{i}) group by 1, 2, 3) group by 1, 2),
b{i + 1} as materialized (select b.part, b.k, coalesce(m.v, b.v) as v from b{i} b left join m{i} m using (part, k))"""


OP12_SQL = f"""with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] as v from kept, range(4) as r(part)),
b0 as materialized (
  select part, dense_rank() over (order by vec_id) - 1 as k, v from parts
  where vec_id in (select vec_id from kept order by vec_id limit {vector_codes.ENTRIES})),
{', '.join(_round_sql(i) for i in range(vector_codes.ROUNDS + 1))},
done as (
  select vec_id, string_agg(lower(printf('%02x', best.k)), '' order by part) as code, cast(sum(best.d) as bigint) as error
  from a{vector_codes.ROUNDS} group by 1),
book as (
  select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by part, k, pos)) as codebooks_sha256
  from (select part, k, unnest(v) as x, unnest(range(len(v))) as pos from b{vector_codes.ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from done join kept using (vec_id), book"""


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf and proof; a seventh of the leaves are tampered with before they are verified."""
    docs = table(spark, folder, "documents").select(*merkle.FIELDS)
    fields = [F.col(name) for name in merkle.FIELDS]
    changed = [F.try_add(c, F.lit(1)) if name == "n_chars" else c for name, c in zip(merkle.FIELDS, fields, strict=True)]
    docs = docs.withColumn("tampered", F.when(remainder("doc_id", 7) == 0, merkle.leaf(*changed)))
    manifest = merkle.manifest(docs, carry=["doc_id", "tampered"])
    found = manifest.proofs()
    subroots = manifest.groups.roots().withColumnRenamed("digest", "subroot")
    shown = F.coalesce("row.tampered", "digest")
    return attach(found, subroots, "tree").select(
        _doc_id(),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.folded(shown, F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(*names: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen(cast({n} as varchar)) || ':' || cast({n} as varchar), '-')" for n in names) + "))"


OP13_SQL = f"""with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as t),
numbered as (
  select *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: cast(ascii(name[i]) as bigint))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 as chosen
  from (select *, cast(doc_id as varchar) as name from documents), crc),
hashed as (
  select doc_id, coalesce('=' || lang, '') as tree, {_leaf_sql(*merkle.FIELDS)} as leaf,
         case when chosen then {_leaf_sql('doc_id', 'source', 'lang', 'n_chars + 1', 'text')} end as tampered
  from numbered),
d as (select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as pos from hashed),
up(tree, level, nodes) as (
  select tree, 0, list(leaf order by pos) from d group by 1
  union all
  select tree, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  from up where len(nodes) > 1),
subroots as (select tree, nodes[1] as subroot, row_number() over (order by tree) - 1 as pos from up where len(nodes) = 1),
over_all(level, nodes) as (
  select 0, list(subroot order by pos) from subroots
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  from over_all where len(nodes) > 1),
paths as (
  select d.tree, d.pos, level, (d.pos >> level) % 2 = 1 as lhs, nodes[xor(d.pos >> level, 1) + 1] as digest
  from d join up on up.tree = d.tree and len(nodes) > 1
  union all
  select d.tree, d.pos, 1000 + level, (s.pos >> level) % 2 = 1, nodes[xor(s.pos >> level, 1) + 1]
  from d join subroots s using (tree) join over_all on len(nodes) > 1),
steps as (select *, row_number() over (partition by tree, pos order by level) as k from paths),
proofs as (select tree, pos, string_agg(digest, '' order by k) as met, count(*) as n from steps group by 1, 2),
folds(tree, pos, k, digest) as (
  select tree, pos, 0, coalesce(tampered, leaf) from d
  union all
  select f.tree, f.pos, f.k + 1, sha256(case when lhs then s.digest || f.digest else f.digest || coalesce(s.digest, '') end)
  from folds f join steps s on s.tree = f.tree and s.pos = f.pos and s.k = f.k + 1),
done as (select tree, pos, arg_max(digest, k) as folded_root from folds group by 1, 2),
top as (select nodes[1] as root from over_all where len(nodes) = 1)
select doc_id, leaf, subroot, root, sha256(coalesce(met, '')) as proof_sha256, folded_root, folded_root = root as verified
from d join subroots using (tree) join done on done.tree = d.tree and done.pos = d.pos
left join proofs on proofs.tree = d.tree and proofs.pos = d.pos, top"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_langid": (op1_langid, None),
    "op2_rule_quality": (op2_rule_quality, None),
    "op3_html_text": (op3_html_text, None),
    "op4_chat_format": (op4_chat_format, OP4_SQL),
    "op5_simhash": (op5_simhash, None),
    "op6_decontaminate": (op6_decontaminate, OP6_SQL),
    "op7_bpe": (op7_bpe, None),
    "op8_line_rules": (op8_line_rules, OP8_SQL),
    "op9_mixing_lm": (op9_mixing_lm, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_secret_scan": (op11_secret_scan, OP11_SQL),
    "op12_vector_codes": (op12_vector_codes, OP12_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
