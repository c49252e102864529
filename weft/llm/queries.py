"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm.decontam import decontaminate
from weft.llm.exact_dedup import exact_dedup
from weft.llm.langid import identify
from weft.llm.licenses import labelled, licences
from weft.llm.linededup import dedup_lines
from weft.llm.lmtrie import score_corpus
from weft.llm.mixing import mix
from weft.llm.prefixtrie import prefix_trie, sequences, spliced
from weft.llm.quality import classify
from weft.llm.repair import audited
from weft.llm.simhash import simhash_components
from weft.llm.tokens import document_token_counts
from weft.llm.urlfilter import judge_urls, tracking_hosts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list is the hosts of which a sixth of the urls or more carry a utm_ parameter."""
    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, tracking_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(licences(_table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(sequences(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_url_filter": op4_url_filter,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_source_mixing": op8_source_mixing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_language_id": op10_language_id,
        "op11_structure_repair": op11_structure_repair,
        "op12_license_scan": op12_license_scan,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


_WORDS5 = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

# crc32 of an ASCII text, with the table of its 256 byte steps in crc(t).
_CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def _repair_sql() -> str:
    """Every state's least (cost, audit), turn by turn; w holds them after insertions."""
    insert = lambda s, role: f"case when {s} is not null then {{'c': {s}.c + 3, 'a': {s}.a || 'I', 'r': {s}.r || chr(10) || '{role}:'}} end"
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"
    edit = lambda s, when, cost, letter, text: f"case when {s} is not null and {when} then {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r{text}}} end"
    kept, told = " || chr(10) || role || ':' || text", lambda role: f" || chr(10) || '{role}:' || text"
    drop = lambda s: edit(s, "true", 4, "D", "")
    keep = lambda s, i: edit(s, f"not forced and i = '{i}'", "late", "K", kept)
    rerole = lambda s, role: edit(s, "not forced", "(3 + late)", "R", told(role))
    return rf"""
        with recursive crc as ({_CRC_TABLE}),
        dealt as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                         {_CRC.format("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations, crc),
        hurt as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text,
                        unnest(range(case when k = 3 then 2 else 1 end)) as copy from dealt where k <> 0),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, substr(text, 1, 64), md5(text)) as pos, substr(role, 1, 1) as i,
                          trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from hurt),
        seen as (select *, row_number() over (partition by conv_id, role, text order by pos) > 1 as again, i || lead(i) over (partition by conv_id order by pos) as pair from placed),
        told as (select *, body = '' or again as forced, case when right(body, 1) in ('.', '!', '?') then 0 else 3 end as late from seen),
        walk as (
            select conv_id, 0 as pos, {{'c': 0, 'a': '', 'r': ''}} as s0, cast(null as struct(c integer, a varchar, r varchar)) as s1,
                   {insert("{'c': 0, 'a': '', 'r': ''}", "user")} as s2, cast({{'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} as struct(c integer, a varchar, r varchar)) as s3
            from (select distinct conv_id from conversations)
            union all
            select conv_id, pos, n0, n1, w2, {least("n3", insert("w2", "assistant"))}
            from (select conv_id, pos, n0, n1, n3, {least("n2", insert("n0", "user"), insert("n1", "user"), insert("n3", "user"))} as w2
                  from (select walk.conv_id, told.pos, {drop("s0")} as n0,
                               {least(drop("s1"), keep("s0", "s"))} as n1,
                               {least(drop("s2"), keep("s0", "u"), keep("s1", "u"), keep("s3", "u"), rerole("s0", "user"), rerole("s1", "user"), rerole("s3", "user"))} as n2,
                               {least(drop("s3"), keep("s2", "a"), rerole("s2", "assistant"))} as n3
                        from walk join told on told.conv_id is not distinct from walk.conv_id and told.pos = walk.pos + 1))),
        done as (select conv_id, {least("s0", "s3")} as best from (select *, row_number() over (partition by conv_id order by pos desc) as back from walk) where back = 1),
        sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (body = '') as blank, count(*) filter (body <> '' and again) as duplicate,
                        count(*) filter (not forced and late = 3) as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from told group by conv_id)
        select done.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               cast(best.c as bigint) as cost, best.a as audit, sha256(substr(best.r, 2)) as repaired_sha256
        from done left join sums on sums.conv_id is not distinct from done.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_structure_repair": _repair_sql(),
        "op13_prefix_trie": rf"""
            with crc as ({_CRC_TABLE}),
            own as (select conv_id as c, list(struct_pack(k := md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), b := strlen(coalesce(text, '')))
                                              order by turn nulls first, coalesce(role, ''), substr(coalesce(text, ''), 1, 64), md5(coalesce(text, ''))) as s
                    from conversations where conv_id is not null group by conv_id),
            dealt as (select c, s, c - c % 5 as base, {_CRC.format("cast(c as varchar)")} % 9 as h from own, crc),
            built as (select d.c, list_concat(coalesce(o.s, [])[1:d.h], d.s[d.h + 1:]) as s from dealt d left join own o on o.c = d.base),
            member as (select c, s, len(s) as size, unnest(range(0, len(s) + 1)) as d from built),
            named as (select c, size, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.k), ',')) as node, case when d > 0 then md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), ',')) end as up,
                             case when d > 0 then s[d].b else 0 end as b from member),
            nodes as (select node, up, min(c) as c, d, count(*) as n, min(b) as b, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (size = d), '')) as ends_sha256 from named group by node, up, d),
            kids as (select up as node, count(*) as k from nodes where d > 0 group by up),
            below as (select a.node, sum((n.n - 1) * n.b) as saved, count(*) filter (kids.k is null) as leaves
                      from nodes n join named a on a.c = n.c and a.d <= n.d left join kids on kids.node = n.node group by a.node)
            select nodes.c as conv_id, cast(nodes.d as bigint) as depth, p.c as parent_conv_id, nodes.n as n_convs, coalesce(kids.k, 0) as n_children, below.leaves as n_leaves,
                   cast(below.saved as bigint) as saved_tokens, nodes.ends_sha256
            from nodes join below using (node) left join kids using (node) left join nodes p on p.node = nodes.up""",
        "op1_line_dedup": r"""
            with l as (select doc_id, text, string_split(text, chr(10)) as raw from documents),
            t as (select doc_id, text, raw, list_filter(list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as ls from l),
            runs as (select doc_id, pos, 3 as n, array_to_string(ls[pos + 1:pos + 3], chr(10)) as key from (select doc_id, ls, unnest(range(0, len(ls) - 2)) as pos from t)
                     union all
                     select doc_id, pos, 1, ls[pos + 1] from (select doc_id, ls, unnest(range(0, len(ls))) as pos from t)
                     where len(list_filter(string_split_regex(ls[pos + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 40
                     union all
                     select doc_id, pos, 2, ls[pos + 1] || chr(10) || ls[pos + 2] from (select doc_id, ls, unnest(range(0, len(ls) - 1)) as pos from t)
                     where len(list_filter(string_split_regex(ls[pos + 1] || ' ' || ls[pos + 2], '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 40),
            firsts as (select n, key, min(struct_pack(d := doc_id, a := pos)) as f from runs group by n, key),
            gone as (select distinct doc_id, unnest(range(pos, pos + runs.n)) as line from runs join firsts using (n, key) where struct_pack(d := doc_id, a := pos) <> f),
            gl as (select doc_id, list(line) as gone from gone group by doc_id),
            k as (select t.doc_id, text, raw, ls, gone, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as b from t left join gl on gl.doc_id = t.doc_id)
            select doc_id, case when gone is null then text else array_to_string(list_filter(raw, lambda x, i: not b[i] or not list_contains(gone, len(list_filter(b[1:i], lambda y: y)) - 1)), chr(10)) end as text,
                   cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed from k""",
        "op4_url_filter": r"""
            with u as (select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as p from pages),
            h as (select page_id, url, case when p = 0 then '' else translate(regexp_extract(substr(url, p + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as host,
                         case when p = 0 then '' else regexp_extract(substr(url, p + 3), '^[^/?#]*([^?#]*)', 1) end as path from u),
            listed as (select host from h group by host having avg(case when contains(url, 'utm_') then 1 else 0 end) >= 1.0 / 6),
            r as (select page_id, host, path, case
                    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
                    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
                    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
                    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from h)
            select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                   when host in (select host from listed) then 'block' else 'allow' end as verdict from r""",
        "op5_benchmark_decontamination": rf"""
            with d as (select doc_id, {_WORDS5} as w from documents),
            b as (select item_id, {_WORDS5} as w from benchmark),
            g as (select distinct item_id, n, array_to_string(w[i + 1:i + n], ' ') as gram
                  from (select item_id, w, least(10, len(w)) as n, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
            lens as (select distinct n from g),
            dg as (select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') as gram
                   from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, lens where len(w) >= n)),
            hit as (select dg.doc_id, dg.n, dg.i, dg.gram from dg where (n, gram) in (select n, gram from g)),
            words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
            found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s
                      from (select distinct hit.doc_id, cast(g.item_id as varchar) as item_id from hit join g using (n, gram)) group by doc_id)
            select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
                   sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
            from d left join words on words.doc_id = d.doc_id left join found on found.doc_id = d.doc_id""",
        "op9_exact_dedup": r"""
            with t as (select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
            select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
                   doc_id = first_value(doc_id) over w as kept, text_sha256
            from t window w as (partition by text_sha256 order by points desc, doc_id)""",
    }
