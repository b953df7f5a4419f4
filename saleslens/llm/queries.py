"""Registered queries over the corpus tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import (
    byte_pairs,
    decontamination,
    licenses,
    merkle_manifest,
    near_copies,
    periodic_runs,
    personal_data,
    resharding,
    site_trees,
    top_products,
    toxicity,
    url_filter,
    vector_copies,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


#: The shards that documents lie in now: dealt by their source, so one of them holds a third of all rows.
OLD_SHARDS = 20


def shard_places(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = resharding.reshard(docs, old)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    scored = toxicity.score(docs, table(spark, folder, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def near_copy_components(spark: SparkSession, folder: str) -> DataFrame:
    rule = near_copies.NearCopyRule(words=3, percent=85, bands=32)
    return near_copies.near_copies(table(spark, folder, "documents", "doc_id", "text"), rule)


def licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.recognise(table(spark, folder, "documents", "doc_id", "text"))
    joined = {c: F.array_join(c, ",") for c in ("sentence_ids", "licences", "unmatched_ids")}
    return found.withColumns(joined).select("doc_id", *joined)


def personal_data_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, folder, "documents", "doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in (*(k.name for k in personal_data.KINDS), personal_data.TERM)]
    base = F.filter("spans", lambda s: s["kind"] != personal_data.TERM)
    return found.select(
        "doc_id",
        *counts,
        F.sha2(personal_data.span_texts(base), 256).alias("base_sha256"),
        personal_data.span_texts(F.col("spans")).alias("spans"),
    )


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = site_trees.extract_text(table(spark, folder, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def byte_pair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return byte_pairs.token_digests(docs, byte_pairs.installed_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = top_products.whole_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64.0)
    return top_products.top_products(vectors.filter("id % 20 = 0"), vectors)


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(table(spark, folder, "pages", "page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontamination.find_leaks(docs, table(spark, folder, "benchmark", "item_id", "text"))


def vector_components(spark: SparkSession, folder: str) -> DataFrame:
    return vector_copies.vector_copies(table(spark, folder, "embeddings", "vec_id", "embedding"))


#: What a leaf of the manifest holds.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf's proof, and the root that it gives for a row whose text may have lost its line breaks."""
    docs = table(spark, folder, "documents", *LEAF_FIELDS)
    bare = F.translate("text", "\n", "")
    changed = merkle_manifest.leaf_digest([bare if c == "text" else F.col(c) for c in LEAF_FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, changed)
    found = merkle_manifest.merkle_manifest(docs, LEAF_FIELDS, carry={"tampered": tampered})
    folded = merkle_manifest.folded(F.col("path"), F.coalesce("tampered", "leaf"))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle_manifest.proof(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, chosen by the checksum of the id, repeats a stretch of its words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.withColumns({"h": h, "words": F.when(h % 10 == 0, words)})
    chosen = chosen.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words")})
    chosen = chosen.withColumn("a", F.col("g") % F.col("n"))
    chosen = chosen.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)

    def word(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def periodic_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, folder, "documents", "doc_id", "text")))
    longest = F.reduce(
        "runs", F.lit(None).cast(periodic_runs.RUN), lambda best, run: F.when(best.isNull() | (run["length"] > best["length"]), run).otherwise(best)
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.floor(F.lit(1000) * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_flow_resharding": shard_places,
    "op2_ftrl_toxicity": toxicity_scores,
    "op3_circulant_minhash": near_copy_components,
    "op4_licence_sentences": licences,
    "op5_disclosure_sanitising": personal_data_spans,
    "op6_site_style_trees": page_texts,
    "op7_byte_pairs": byte_pair_tokens,
    "op8_norm_buckets": top_inner_products,
    "op9_redirect_equivalence": url_verdicts,
    "op10_rare_seed_alignment": benchmark_leaks,
    "op11_projection_collisions": vector_components,
    "op12_bitmap_rank_manifest": manifest_proofs,
    "op13_dyadic_square_catching": periodic_texts,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _licence_sql() -> str:
    """Every sentence of every text against every pattern, then the rules as replacements in their order."""
    patterns = dict(licenses.SENTENCES)
    first = " ".join(f"when regexp_matches(s, '{pattern}') then '{name}'" for name, pattern in licenses.SENTENCES)
    ends = ", ".join(
        f"case when regexp_matches(s, '{patterns[n]}') then {{'at': strpos(s, regexp_extract(s, '{patterns[n]}')) + "
        f"length(regexp_extract(s, '{patterns[n]}')), 'id': '{n}'}} end"
        for n in licenses.STATED
    )
    stated = ", ".join(f"'{name}'" for name in licenses.STATED)
    names = ", ".join(f"('{name.lower()}', '{name}')" for name in licenses.SPDX_NAMES)
    families = ", ".join(f"('{family}')" for family in licenses.SPDX_FAMILIES)
    marked = "'<' || array_to_string(ids, '><') || '>'"
    for name, sequence in licenses.RULES:
        marked = f"replace({marked}, '<{sequence.replace(' ', '><')}>', '[{name}]')"
    return f"""
        with spdx as (
            select map_from_entries(list({{'k': k, 'v': v}})) as known from (
                select * from (values {names}) n(k, v)
                union all select lower(f || e), f || e from (values {families}) a(f), (values (''), ('-only'), ('-or-later')) b(e))
        ), parts as (
            select row, doc_id, part, place, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) as s from (
                select row, doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.;!?]+\\s+|\\s*\\n\\s*')) as part,
                    generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.;!?]+\\s+|\\s*\\n\\s*'), 1) as place
                from (select *, row_number() over () as row from documents))
        ), said as (
            select row, doc_id, place, case
                when regexp_matches(part, '{licenses.SPDX_TAG}') then list_transform(
                    list_filter(regexp_extract_all(regexp_extract(part, '{licenses.SPDX_EXPRESSION}', 1),
                        '[A-Za-z0-9][A-Za-z0-9.+-]*(?:\\s+WITH\\s+[A-Za-z0-9][A-Za-z0-9.+-]*)?'), lambda t: t not in ('AND', 'OR')),
                    lambda t: coalesce('spdx:' || coalesce(known[lower(regexp_replace(split_part(t, ' ', 1), '\\+$', '-or-later'))],
                        case when starts_with(t, 'LicenseRef-') then split_part(t, ' ', 1) end)
                        || case when contains(t, ' ') then regexp_replace(regexp_extract(t, '\\s.*$'), '\\s+', ' ', 'g') else '' end, 'spdx-unknown'))
                when (case {first} end) in ({stated}) then list_transform(
                    list_sort(list_filter([{ends}], lambda f: f is not null)), lambda f: f.id)
                when (case {first} end) is not null then [case {first} end] else [] end as ids
            from parts, spdx
        ), sentences as (
            select any_value(doc_id) as doc_id, flatten(list(ids order by place)) as ids from said group by row
        ), marked as (
            select doc_id, ids, case when len(ids) > 0 then regexp_replace({marked}, '<spdx:([^>]*)>', '[\\1]', 'g') else '' end as m from sentences
        )
        select doc_id, array_to_string(ids, ',') as sentence_ids,
            array_to_string(list_sort(list_distinct(regexp_extract_all(m, '\\[([^\\]]*)\\]', 1))), ',') as licences,
            array_to_string(regexp_extract_all(m, '<([^>]*)>', 1), ',') as unmatched_ids
        from marked
    """


def _url_sql() -> str:
    """Rules by a join, links of the pages followed by recursion."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)
    return f"""
        with recursive rules(verdict, host, path) as (values {rules}),
        tags as (
            select url, unnest(regexp_extract_all(page, '(?i)<(?:link|meta)\\b[^>]*>')) as tag
            from (select url, regexp_replace(html, '<!--.*?-->|<script\\b.*?</script\\s*>', ' ', 'gis') as page from pages)
            where strpos(url, '://') > 0
        ), found as (
            select url, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))', 1)
                || regexp_extract(tag, '(?i)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))', 2)
                || regexp_extract(tag, '(?i)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))', 3) as link
            from tags where regexp_matches(tag, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b')
            union all
            select url, regexp_extract(tag, '(?i)url\\s*=\\s*[''"]?([^''">\\s]+)', 1)
            from tags where regexp_matches(tag, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
        ), links as (
            select url as source, case
                when link = '' then null
                when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
                when starts_with(link, '//') then regexp_extract(url, '^(.*?)://', 1) || ':' || link
                when starts_with(link, '/') then regexp_extract(url, '^.*?://[^/?#]*') || link
                else regexp_extract(url, '^.*?://[^/?#]*') || coalesce(nullif(regexp_extract(
                    regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^(.*/)'), ''), '/') || link end as target
            from (select url, trim(replace(link, '&amp;', '&')) as link from found)
        ), urls as (
            select distinct url from (select url from pages union all select source from links union all select target from links)
        ), parsed as (
            select url, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
                case when strpos(url, '://') > 0 then translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER})
                    || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) end as resource
            from (select url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from urls)
        ), judged as (
            select p.url, any_value(p.host) as host, any_value(p.path) as path, any_value(p.resource) as resource,
                arg_max(r.host || r.path, length(r.host || r.path)) as rule,
                arg_max(r.verdict, length(r.host || r.path)) as own
            from parsed p left join rules r
                on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
            group by p.url
        ), edges as (
            select a.resource as a, b.resource as b from links join judged a on a.url = source join judged b on b.url = target
            where a.resource <> b.resource
            union
            select b.resource, a.resource from links join judged a on a.url = source join judged b on b.url = target
            where a.resource <> b.resource
        ), reach(node, other) as (
            select a, a from edges union select node, b from reach join edges on other = a
        ), aliases as (
            select node, case when bool_or(own = 'block') and not coalesce(bool_or(own = 'allow'), false)
                then 'block' else 'allow' end as verdict
            from reach join judged on resource = other group by node
        )
        select page_id, host, path, rule, coalesce(own, aliases.verdict, 'allow') as verdict
        from pages left join judged on pages.url is not distinct from judged.url left join aliases on node = resource
    """


def _digest_sql(text: str) -> str:
    """A leaf's digest over a row of documents whose text is `text`."""
    values = [f"({text})" if c == "text" else f"{c}::varchar" for c in LEAF_FIELDS]
    parts = (f"coalesce(octet_length(encode({v}))::varchar || ':' || {v}, '-')" for v in values)
    return f"sha256({' || '.join(parts)})"


def _manifest_sql() -> str:
    """Every level by a recursion that groups the one below, then every leaf folded level by level."""

    def levels(name: str, base: str) -> str:
        return f"""{name}(tree, level, place, digest, n) as (
            {base}
            union all
            select tree, level + 1, place // 3, sha256(string_agg(digest, '' order by place)), (any_value(n) + 2) // 3
            from {name} where n > 1 group by tree, level, place // 3
        )"""

    def siblings(name: str) -> str:
        return f"""{name}_runs as (
            select a.tree, a.level, a.place,
                coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), '') as lefts,
                coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '') as rights
            from {name} a join {name} b on a.tree is not distinct from b.tree and a.level = b.level and a.place // 3 = b.place // 3
            where a.n > 1 group by all
        )"""

    def folds(name: str, base: str, runs: str) -> str:
        return f"""{name}(row, tree, level, place, folded, proof) as (
            {base}
            union all
            select f.row, f.tree, f.level + 1, f.place // 3, sha256(lefts || folded || rights), proof || lefts || rights
            from {name} f join {runs} r on f.tree is not distinct from r.tree and f.level = r.level and f.place = r.place
        ), {name}_end as (select row, tree, max_by(folded, level) as folded, max_by(proof, level) as proof from {name} group by row, tree)"""

    return f"""
        with recursive
        checksums(i, c) as (
            select i, list_reduce(list_concat([i], range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
            from range(256) r(i)
        ), steps as (select list(c order by i) as step from checksums),
        rows as (
            select *, row_number() over () as row, xor(4294967295, list_reduce(
                list_concat([4294967295::bigint], [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
                lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) as checksum
            from documents, steps
        ), leaves as (
            select row, doc_id, source as tree, {_digest_sql("text")} as leaf,
                case when checksum % 2 = 0 then {_digest_sql("replace(text, chr(10), '')")} else {_digest_sql("text")} end as changed
            from rows
        ), placed as (
            select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place,
                count(*) over (partition by tree) as n
            from leaves
        ),
        {levels("nodes", "select tree, 0, place, leaf, n from placed")},
        {siblings("nodes")},
        {folds("paths", "select row, tree, 0, place, changed, '' from placed", "nodes_runs")},
        subroots as (select tree as source, max_by(digest, level) as subroot from nodes group by tree),
        sources as (
            select source, subroot, row_number() over (order by encode(source) nulls first) - 1 as place, count(*) over () as n from subroots
        ),
        {levels("tops", "select 0, 0, place, subroot, n from sources")},
        {siblings("tops")},
        ended as (
            select p.row, p.proof, p.folded, s.place, s.subroot from paths_end p join sources s on p.tree is not distinct from s.source
        ),
        {folds("whole", "select row, 0, 0, place, folded, proof from ended", "tops_runs")}
        select l.doc_id, l.leaf, e.subroot, t.root, sha256(w.proof) as proof_sha256, w.folded as folded_root, w.folded = t.root as verified
        from leaves l join ended e using (row) join whole_end w using (row), (select max_by(digest, level) as root from tops) t
    """


SQL: dict[str, str] = {
    "op12_bitmap_rank_manifest": _manifest_sql(),
    "op11_projection_collisions": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e
            from embeddings
            where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from v a join v b
                on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(node, other) as (
            select a, a from links union select node, b from reach join links on other = a
        ), known as (
            select vec_id, (select count(*) from links where a = vec_id) as n_links,
                coalesce((select min(other) from reach where node = vec_id), vec_id) as component_id
            from embeddings
        )
        select vec_id, n_links, component_id, vec_id = component_id as kept from known
    """,
    "op4_licence_sentences": _licence_sql(),
    "op9_redirect_equivalence": _url_sql(),
    "op8_norm_buckets": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
        )
        select query_id, rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
        where rank <= 20
    """,
}
