"""Registered queries of the text operators, one per operator, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bbit_minhash, fim_scatter, importance_select, line_winnow, mixing, near_join, nra_topk, packing, quality_ftrl, quality_rules
from riskloom.llm import sharding, surrogates, toxicity_nbsvm


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tree of the mixture.  The tables have no domain; sources are dealt to three by number.
LEVELS = {"domain": "concat('domain', coalesce(try_cast(substr(source, 4) as int), 0) % 3)", "lang": "lang", "source": "source"}
WEIGHTS = ["case mix_domain when 'domain0' then 0.5 else 0.25 end",
           "case mix_lang when 'en' then 0.5 when 'de' then 0.25 else 0.125 end", "1.0"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cutoffs by language at 2 percent of good documents, 90 percent sure."""
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "lang", alpha=0.02, delta=0.1)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, by weights of domain, language and source; up to three epochs of a leaf."""
    taken = mixing.mix(_table(spark, sf_dir, "documents"), LEVELS, WEIGHTS, share_of_tokens=0.5, max_epochs=3)
    return taken.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"),
                        F.col("mix_source").alias("source"), F.col("epoch").cast("long").alias("epoch"), "tokens")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data; a real run passes its own secret key."""
    return surrogates.replace(_table(spark, sf_dir, "documents"), key="example key").select("doc_id", "n_entities", "text")


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id 20 divides."""
    return nra_topk.top_k(_table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op5_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of 50 words and more."""
    return line_winnow.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, equal texts together."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at Jaccard 0.9 on three-word shingles."""
    found = near_join.join_components(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_ftrl.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at Jaccard 0.85 on five-word shingles."""
    found = bbit_minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=5, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_fim_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle outputs of all documents and the texts restored from them, as digests."""
    both = fim_scatter.restore(fim_scatter.transform(_table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents with 20 words, drawn towards the distribution of the benchmark texts."""
    return importance_select.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, min_words=20)


REGISTRY = {f.__name__: f for f in (op1_quality_rules, op2_mix_sources, op3_pii_surrogates, op4_nra_topk, op5_toxicity_nbsvm, op6_best_fit_packing, op7_line_winnowing,
                                  op8_label_propagation, op9_ngram_jaccard_join, op10_quality_ftrl, op11_bbit_minhash, op12_fim_scatter,
                                  op13_importance_resampling)}
def _water(nodes: str, parent: str, own: str) -> str:
    """SQL of the budgets among children: ``nodes`` with w, cap, pb, grouped by ``parent``."""
    part = f"partition by {parent}" if parent else ""
    return f"""(select *, case when fo is null or ratio < fo then cap else least(cap, fl * w) end b from (
        select *, min(case when lv < ratio then ratio end) over ({part}) fo,
               first_value(lv) over ({part} order by case when lv < ratio then 0 else 1 end, ratio, {own}) fl from (
        select *, (pb - coalesce(sum(cap) over ({part} order by ratio, {own} rows between unbounded preceding and 1 preceding), 0))
               / sum(w) over ({part} order by ratio, {own} rows between current row and unbounded following) lv from (
        select *, cap / w ratio from {nodes}))))"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased letters, digits and characters beyond ASCII.
_PLAIN_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _linked(n: int, num: int) -> str:
    """SQL of the components of documents linked at Jaccard ``num`` percent on ``n``-word shingles."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
        s as (select doc_id, unnest(case
                when len(w) >= {n} then list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
        n as (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {num} * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r as (select doc_id a, doc_id b from n union select r.a, e.b from r join e on r.b = e.a),
        m as (select a, min(b) c from r group by a)
        select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.c, d.doc_id) component_id
        from documents d left join n on n.doc_id = d.doc_id left join m on m.a = d.doc_id"""


#: DuckDB twins.  The others are trained, iterative or tokenised, or too slow in SQL on whole tables; tests hold them
#: against brute-force versions.
SQL: dict[str, str] = {
    "op2_mix_sources": rf"""
        with d as (select doc_id, concat('domain', coalesce(try_cast(substr(source, 4) as integer), 0) % 3) as domain, coalesce(lang, '') lang,
                          coalesce(source, '') source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) t from documents),
        leaf as (select domain, lang, source, sum(t)::double tok, 3 * sum(t)::double cap from d group by all),
        n0 as (select domain, sum(cap) cap, case domain when 'domain0' then 0.5::double else 0.25 end w, (select sum(t) * 0.5::double from d) pb from leaf group by domain),
        b0 as (select domain, b from {_water('n0', '', 'domain')}),
        n1 as (select domain, lang, sum(cap) cap, case lang when 'en' then 0.5::double when 'de' then 0.25 else 0.125 end w, any_value(b) pb from leaf join b0 using (domain) group by domain, lang),
        b1 as (select domain, lang, b from {_water('n1', 'domain', 'lang')}),
        n2 as (select domain, lang, source, tok, cap, 1.0::double w, b pb from leaf join b1 using (domain, lang)),
        b2 as (select domain, lang, source, tok, floor(b + 1e-6) b from {_water('n2', 'domain, lang', 'source')}),
        p as (select domain, lang, source, cast(case when tok > 0 then floor(b / tok) else 0 end as bigint) f, b - tok * case when tok > 0 then floor(b / tok) else 0 end l from b2),
        o as (select d.*, f, l, sum(t) over (partition by domain, lang, source order by cast('0x' || substr(md5('7|' || f || '|' || doc_id), 1, 15) as bigint), doc_id
                     rows unbounded preceding) c from d join p using (domain, lang, source))
        select doc_id, domain, lang, source, epoch, t tokens from (
            select *, unnest(range(f)) epoch from o union all select *, f epoch from o where l > 0 and c <= l)""",
    "op4_nra_topk": """
        with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) x from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        s as (select q.vec_id query_id, v.vec_id, cast(list_inner_product(cast(q.x as double[]), cast(v.x as double[])) as bigint) score
              from v q join v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
    "op9_ngram_jaccard_join": _linked(3, 90),
    "op11_bbit_minhash": f"select *, doc_id = component_id as kept from ({_linked(5, 85)})",
    "op12_fim_scatter": r"""
        with d as (select doc_id, coalesce(text, '') x, sha256('1:' || doc_id) g from documents),
        t as (select *, len(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]')) n, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') t,
                     list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(g, i, 8) as bigint)) h from d),
        k as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
                     case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h[3] % 100 >= 90 then 'plain'
                          when h[4] % 100 < 20 then 'spm' else 'psm' end form from t),
        s as (select *, array_to_string(t[1:a], '') p, array_to_string(t[a + 1:b], '') m, array_to_string(t[b + 1:], '') s from k)
        select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
               sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
               sha256(x) restored_sha256 from s""",
    "op13_importance_resampling": rf"""
        with tab as (select list(v order by i) tab from (select i, list_reduce(list_prepend(i, range(8)),
                       lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from (select unnest(range(256)) i))),
        w as (select doc_id, unnest({_PLAIN_WORDS}) w from documents),
        b as (select unnest({_PLAIN_WORDS}) w from benchmark),
        v as (select w, hex(encode(w)) h from (select w from w union select w from b)),
        c as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
                        lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 k from v, tab),
        s as (select k, count(*) s from w join c using (w) group by k),
        t as (select k, count(*) t from b join c using (w) group by k),
        g as (select k, cast(floor(1000 * ln(((coalesce(t, 0) + 1) * ((select count(*) from w) + 10000))::double
                                             / ((coalesce(s, 0) + 1) * ((select count(*) from b) + 10000)))) as bigint) g from s full join t using (k)),
        f as (select doc_id, count(*) n, sum(g) weight from w join c using (w) join g using (k) group by doc_id),
        d as (select doc_id, coalesce(n, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
                     (coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint))::bigint score
              from documents left join f using (doc_id)),
        r as (select doc_id, row_number() over (order by score desc, doc_id) r from d where n_features >= 20)
        select doc_id, n_features, weight, score, case when r <= (select count(*) * 10 // 100 from r) then r end as rank from d left join r using (doc_id)""",
}
