"""Queries on runs, caches, configurations, services and their logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwright import config
from leafwright.functions import text as T
from leafwright.operators import backends, cache, report, selection
from leafwright.sources import results
from leafwright.sources.driver_tables import SQL_PAGES, attempts, pages, table

from . import extract
from .registry import query

ATTEMPTS = "with t as (select user_id as job, event_id, ts, event_type <> 'error' as ok, value as seconds, event_type as engine from events)"


def _attempts(spark, d):
    return attempts(table(spark, d, "events"))


@query("select user_id as job, arg_max(event_type, ts) as state, count(*) as polls from events group by 1")
def job_last_state(spark, d):
    return report.last_state(_attempts(spark, d).withColumn("state", F.col("engine")))


@query(
    ATTEMPTS
    + """, n as (select *, row_number() over (partition by job order by ts, event_id) as n from t qualify n <= 3)
    select job, coalesce(min(n) filter (where ok), count(*))::bigint as used, bool_or(ok) as ok, min(n) filter (where ok)::bigint as at_try from n group by 1"""
)
def retry_log(spark, d):
    return report.first_success(_attempts(spark, d))


@query("select event_type as engine, user_id as page, event_id from events qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1")
def latest_per_key(spark, d):
    return _attempts(spark, d).groupBy("engine", F.col("job").alias("page")).agg(F.max_by("attempt_id", F.struct("at", "attempt_id")).alias("event_id"))


@query(
    """with s as (select event_type as engine, user_id as page, round(sum(value), 4) as score from events group by 1, 2), r as (select *, rank() over (partition by page order by score) as r from s)
    select engine, sum(r)::bigint as rank_sum, count(*) as pages from r group by 1"""
)
def rank_sum(spark, d):
    scores = _attempts(spark, d).groupBy("engine", F.col("job").alias("page")).agg(F.round(F.sum("seconds"), 4).alias("score"))
    return report.rank_sums(scores)


@query("select user_id as job, round((count(*) filter (where event_type <> 'error')) / nullif(sum(value), 0) * 60, 4) as per_minute from events group by 1")
def throughput(spark, d):
    return _attempts(spark, d).groupBy("job").agg(F.round(F.count_if("ok") / F.nullif(F.sum("seconds"), F.lit(0.0)) * 60, 4).alias("per_minute"))


@query(
    """with n as (select event_type as grp, value, row_number() over (partition by event_type order by ts, event_id) as n from events)
    select grp, max(value) filter (where n = 1) as cold, round(avg(value) filter (where n > 1), 6) as warm_mean, count(*) as n from n group by 1"""
)
def cold_warm_mean(spark, d):
    items = _attempts(spark, d).select(F.col("engine").alias("grp"), F.struct("at", "attempt_id").alias("seq"), "seconds")
    return report.warm_mean(items).withColumn("warm_mean", F.round("warm_mean", 6))


@query(
    """with s as (select event_type as grp, count(*) filter (where user_id % 2 = 0) as sn, sum(value) filter (where user_id % 2 = 0) as ss, count(*) as ln, sum(value) as ls from events group by 1)
    select grp, round((ls - ss) / nullif(ln - sn, 0), 6) as per_item, round(ss - (ls - ss) / nullif(ln - sn, 0) * sn, 4) as fixed from s"""
)
def diff_cost(spark, d):
    even = F.col("job") % 2 == 0
    totals = _attempts(spark, d).groupBy(F.col("engine").alias("grp")).agg(
        F.count_if(even).alias("small_n"), F.sum(F.when(even, F.col("seconds"))).alias("small_s"), F.count("*").alias("large_n"), F.sum("seconds").alias("large_s")
    )
    return report.differential(totals).select("grp", F.round("per_item", 6).alias("per_item"), F.round("fixed", 4).alias("fixed"))


@query("select user_id as job, event_type as engine, count(*) as n, count(*) filter (where event_type <> 'error') as ok, round(sum(value), 4) as seconds from events group by 1, 2")
def engine_totals(spark, d):
    """A row for each job and engine that it used, whatever engines there are."""
    return report.engine_totals(_attempts(spark, d)).withColumn("seconds", F.round("seconds", 4))


@query(
    """select user_id as job, event_id, trunc(value * 100) / 4 as prompt_ms, (user_id + 10)::bigint as prompt_tokens, (event_id % 1000) / 8.0::double as decode_ms, (event_id % 97)::bigint as decode_tokens from events where event_type = 'view'"""
)
def log_timings(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    log = F.concat(
        F.lit("slot launched\nprompt eval time =  "), number(F.expr("try_cast(value * 100 as bigint)") / 4), F.lit(" ms / "), (F.col("user_id") + 10).cast("string"), F.lit(" tokens ( 1 ms per token)\n       eval time =  "),
        F.format_string("%.3f", F.col("event_id") % 1000 / F.lit(8.0)), F.lit(" ms / "), (F.col("event_id") % 97).cast("string"), F.lit(" tokens\ndone"),
    )
    return e.select(F.col("user_id").alias("job"), "event_id", F.explode(results.log_timings(log)).alias("x")).select("job", "event_id", "x.*")


ENGINE = "['hybrid', 'glm', 'ov', 'dsocr'][(doc_id % 4 + 1)::int]"
SIG = f"""with {SQL_PAGES}, e as (select doc_id, page_no, text, {ENGINE} as engine, 150 as dpi from page),
    b as (select *, '{{' || case when engine in ('hybrid', 'ov') then '"backend": "openvino", ' else '' end || '"dpi": 150, "engine": "' || engine || '", '
        || case when engine <> 'ov' then '"model": "m-' || engine || '", ' else '' end || '"source": "local"' || case when engine = 'ov' then ', "tier": "small"' else '' end || ', "ver": 1}}' as blob from e),
    k as (select doc_id, page_no, text, engine, 'doc' || doc_id || '_p' || page_no || '_' || engine || '_d150_' || substr(sha256(blob), 1, 12) as base from b),
    c as (select *, base || '_' || substr(sha256(text), 1, 12) as cache_key from k)"""


def _keyed(spark, d):
    e = F.array(*map(F.lit, ("hybrid", "glm", "ov", "dsocr")))[(F.col("doc_id") % 4).cast("int")]
    df = pages(table(spark, d, "documents")).withColumn("engine", e)
    sig = cache.fingerprint(F.col("engine"), F.lit(150), F.lit("local"), F.lit("openvino"), F.concat(F.lit("m-"), "engine"), F.lit("small"))
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return df.select("doc_id", "page_no", "text", "engine", cache.key(stem, F.col("page_no"), F.col("engine"), F.lit(150), sig, F.col("text")).alias("cache_key"))


@query(SIG + " select doc_id, page_no, cache_key from c")
def cache_fingerprint(spark, d):
    return _keyed(spark, d).select("doc_id", "page_no", "cache_key")


def _held(keyed):
    return keyed.where((F.col("doc_id") + F.col("page_no")) % 3 == 0).select("cache_key", F.concat(F.lit("old "), F.left("text", F.lit(20))).alias("text"))


@query(SIG + " select doc_id, page_no, cache_key from c where (doc_id + page_no) % 3 <> 0")
def cache_miss(spark, d):
    keyed = _keyed(spark, d)
    return cache.work_list(keyed, _held(keyed)).select("doc_id", "page_no", "cache_key")


@query(SIG + " select doc_id, page_no, (doc_id + page_no) % 3 = 0 as hit, case when (doc_id + page_no) % 3 = 0 then 'old ' || left(text, 20) end as cached_text from c")
def cache_lookup(spark, d):
    keyed = _keyed(spark, d)
    return cache.looked_up(keyed, _held(keyed)).select("doc_id", "page_no", "hit", "cached_text")


@query(SIG + " select cache_key, case when (doc_id + page_no) % 3 = 0 and not (page_no = 1 and text <> '') then 'old ' || left(text, 20) else text end as text from c where (doc_id + page_no) % 3 = 0 or (page_no = 1 and text <> '')")
def cache_merge(spark, d):
    keyed = _keyed(spark, d)
    return cache.written_back(keyed.where("page_no = 1"), _held(keyed))


HEAD = T.MATHJAX.replace("'", "''")


@query(
    f"""with t as (select page_id, case page_id % 5 when 0 then html when 1 then '```html' || chr(10) || '<html><head></head><body>x</body></html>' || chr(10) || '```' when 2 then '<html><body>' || page_id || '</body></html>'
        when 3 then '<html>plain' else '``` ' || url || ' ```' end as t from pages),
    u as (select page_id, trim(case when starts_with(t, '```html') then substr(t, 8) when starts_with(t, '```') then substr(t, 4) else t end, ' ' || chr(10)) as t from t),
    v as (select page_id, trim(case when ends_with(t, '```') then left(t, -3) else t end, ' ' || chr(10)) as t from u)
    select page_id, case when starts_with(t, '<html') then case
        when contains(t, '<head>') then left(t, instr(t, '<head>') + 5) || chr(10) || '{HEAD}' || substr(t, instr(t, '<head>') + 6)
        when contains(t, '<body>') then left(t, instr(t, '<body>') + 5) || chr(10) || '{HEAD}' || substr(t, instr(t, '<body>') + 6) else '{HEAD}' || t end else '{HEAD}' || t end as html from v"""
)
def html_mathjax(spark, d):
    k, url = F.col("page_id") % 5, F.col("url")
    made = (
        F.when(k == 0, F.col("html")).when(k == 1, F.lit("```html\n<html><head></head><body>x</body></html>\n```"))
        .when(k == 2, F.concat(F.lit("<html><body>"), F.col("page_id").cast("string"), F.lit("</body></html>"))).when(k == 3, F.lit("<html>plain")).otherwise(F.concat(F.lit("``` "), url, F.lit(" ```")))
    )
    return table(spark, d, "pages").select("page_id", T.with_mathjax(made).alias("html"))


@query(
    """select conv_id, string_agg(role || ':' || case when turn % 2 = 0 then 'text,image' else 'image,text' end || ':' || length(text), '|' order by turn, role, text) as messages, count(*) as n from conversations group by 1"""
)
def chat_assembly(spark, d):
    text, image = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("url")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("data:,").alias("url"))
    content = F.when(F.col("turn") % 2 == 0, F.array(text, image)).otherwise(F.array(image, text))
    each = F.array_sort(F.collect_list(F.struct("turn", "role", "text", content.alias("content"))))
    shown = F.transform(each, lambda m: F.concat(m.role, F.lit(":"), F.array_join(F.transform(m.content, lambda c: c.type), ","), F.lit(":"), F.length(m.text).cast("string")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(shown, "|").alias("messages"), F.count("*").alias("n"))


@query(
    r"""select page_id, regexp_replace('url: ' || url || chr(10) || case page_id % 3 when 0 then 'api_key: "k-' || page_id || '"' when 1 then 'api_key:k' || page_id || ' # x' else 'key: none' end, '(api_key\s*:\s*["'']?)([^"''\s]+)', '\1***', 'g') as masked from pages"""
)
def mask_secrets(spark, d):
    i = F.col("page_id").cast("string")
    key = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('api_key: "k-'), i, F.lit('"'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("api_key:k"), i, F.lit(" # x"))).otherwise("key: none")
    return table(spark, d, "pages").select("page_id", T.masked(F.concat(F.lit("url: "), "url", F.lit("\n"), key)).alias("masked"))


@query(
    """with t as (select conv_id as job, turn, role, case when turn % 4 = 3 then '' else text end as text from conversations where turn % 5 <> 4)
    select c.conv_id as job, coalesce(string_agg(t.text, chr(10) || chr(10) order by t.turn, t.role, t.text), '') as text,
        case when count(t.text) = 0 then 'empty result' end as error
    from (select distinct conv_id from conversations) c left join t on t.job = c.conv_id group by 1"""
)
def jsonl_parse(spark, d):
    text = F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text"))
    good = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(text.alias("text")).alias("markdown"))).alias("layoutParsingResults")).alias("result")))
    line = F.when(F.col("turn") % 5 == 4, F.lit('{"result": {"layoutPars')).otherwise(good)
    return results.jsonl_texts(table(spark, d, "conversations").select(F.col("conv_id").alias("job"), F.struct("turn", "role", "text").alias("seq"), line.alias("line")))


@query("select doc_id, case doc_id % 3 when 0 then 'localhost,::1' when 1 then '' else source || ',10.0.0.1' end as no_proxy from documents")
def no_proxy_clean(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" localhost ,[::1],, ::1")).when(F.col("doc_id") % 3 == 1, "[::1]").otherwise(F.concat("source", F.lit(" ,10.0.0.1 , [fe80::1]")))
    return table(spark, d, "documents").select("doc_id", T.plain_no_proxy(raw).alias("no_proxy"))


@query(
    """with r as (select doc_id, ['auto', 'ov', 'bad', 'glm', 'hybrid'][(doc_id % 5 + 1)::int] as engine, [null, 'local', 'cloud', 'moon'][(doc_id % 4 + 1)::int] as source,
        [null, '150', 'x', '49', '600', '601'][(doc_id % 6 + 1)::int] as dpi, [null, '/abs/../x', 'a/../b', 'out', 'a\\..\\b', 'a..b/c'][(doc_id // 7 % 6 + 1)::int] as dir from documents)
    select doc_id, case when engine = 'bad' then 'engine' when source = 'moon' then 'source' when dpi is not null and (try_cast(dpi as int) is null or try_cast(dpi as int) not between 50 and 600) then 'dpi'
        when dir in ('a/../b', 'a\\..\\b') then 'output_dir' end as fault from r"""
)
def request_validation(spark, d):
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    i = F.col("doc_id")
    fault = report.request_fault(
        pick(("auto", "ov", "bad", "glm", "hybrid"), i % 5), pick((None, "local", "cloud", "moon"), i % 4), pick((None, "150", "x", "49", "600", "601"), i % 6),
        pick((None, "/abs/../x", "a/../b", "out", "a\\..\\b", "a..b/c"), F.floor(i / 7) % 6),
    )
    return table(spark, d, "documents").select("doc_id", fault.alias("fault"))


@query(
    """with b as (select user_id as k, 'p' || (event_id % 7) as path, max(event_id)::varchar as value from events where event_type = 'view' group by 1, 2),
    o as (select user_id as k, 'p' || (event_id % 9) as path, case when user_id % 4 = 0 then null else max(event_id)::varchar end as value from events where event_type = 'click' group by 1, 2)
    select coalesce(b.k, o.k) as k, coalesce(b.path, o.path) as path, case when o.k is not null then o.value else b.value end as value from b full join o on b.k = o.k and b.path = o.path"""
)
def config_overlay(spark, d):
    e = table(spark, d, "events")
    part = lambda kind, n: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("k"), F.concat(F.lit("p"), (F.col("event_id") % n).cast("string")).alias("path")).agg(F.max("event_id").cast("string").alias("value"))
    over = part("click", 9).withColumn("value", F.when(F.col("k") % 4 != 0, F.col("value")))
    return config.overlaid(part("view", 7), over, ["k"])


@query(
    """with p as (select p_partkey as job, r as rank, ['llama', 'openvino', 'paddle'][r] as backend, (p_partkey * r) % 3 = 1 as ok from part, range(1, 4) x(r)),
    f as (select job, min(rank) filter (where ok) as hit from p group by 1)
    select job, coalesce(max(backend) filter (where rank = hit), 'paddle') as backend, coalesce(string_agg(backend || ':no ' || rank, ';' order by rank) filter (where not ok and (hit is null or rank < hit)), '') as failed
    from p join f using (job) group by 1"""
)
def recogniser_choice(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("job"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))
    backend = F.array(F.lit("llama"), F.lit("openvino"), F.lit("paddle"))[F.col("rank") - 1]
    return selection.first_passing(rows.select("job", "rank", backend.alias("backend"), ((F.col("job") * F.col("rank")) % 3 == 1).alias("ok"), F.concat(F.lit("no "), F.col("rank").cast("string")).alias("reason")))


@query("select doc_id, line_no, x0, y0, x1, y1, text from (select doc_id, (i - 1)::int as line_no, i::double as x0, (2 * i)::double as y0, (i + 5.5)::double as x1, (3 * i)::double as y1, t as text, i from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)) where i % 6 <> 0")
def ocr_dump_parse(spark, d):
    i = F.col("line_no") + 1
    box = F.concat_ws(",", i.cast("string"), (2 * i).cast("string"), (i + 5.5).cast("string"), (3 * i).cast("string"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "t"))
    dump = lines.select("doc_id", "line_no", F.when(i % 6 == 0, F.lit("# comment")).otherwise(F.concat(box, F.lit(" | "), "t")).alias("value"))
    return results.dumped_lines(dump).select("doc_id", "line_no", "bbox.*", "text")


@query(
    """select page_id, case when page_id % 4 = 0 then null when page_id % 4 = 1 then true else false end as gpu, page_id % 5 >= 4 as offloaded, regexp_replace(url, '^.*[/\\\\]', '') as tag from pages"""
)
def device_probe(spark, d):
    """Device listings, offload checks and model tags as columns."""
    k = F.col("page_id")
    listing = F.when(k % 4 == 1, "Available devices:\n  CUDA0: card\n  CPU").when(k % 4 == 0, F.lit(None).cast("string")).otherwise("Available devices:\n  Vulkan0 CUDA\n  CPU")
    gpu = F.exists(F.split(listing, "\n"), lambda x: T.strip(x).startswith("CUDA"))
    delta, size = k % 5 * 200, F.lit(900) + F.lit(100)
    return table(spark, d, "pages").select("page_id", gpu.alias("gpu"), (delta >= F.lit(0.8) * size).alias("offloaded"), F.element_at(F.split("url", r"[/\\]", -1), -1).alias("tag"))


@query(
    """with f as (select event_id as machine, event_id % 7 <> 0 as exe, event_id % 5 <> 0 as model, case when event_id % 11 = 0 then null else event_id % 3 <> 0 end as mmproj, user_id % 4 = 0 as up,
        case when event_id % 13 = 0 then null else (event_id * 37) % 6000 end as free, case event_id % 6 when 0 then 'GPU ' when 1 then 'openvino' else 'auto' end as forced,
        case when user_id % 2 = 0 then 'gpu' else 'cpu' end as device, user_id % 3 as cuda, event_id % 9 as broken from events),
    p as (select *, case when not exe then 'exe' when not model then 'model' when not coalesce(mmproj, false) then 'mmproj' when not up and free < 3000 then 'memory' end as why,
        case when forced = 'auto' then case when device = 'gpu' and cuda >= 1 then 'gpu' else 'cpu' end else lower(trim(forced)) end as backend from f)
    select machine, why is null as ok, coalesce(why, case when up then 'running' else 'ok' end) as reason, backend,
        case when broken = 0 then null when broken < 5 and backend <> 'cpu' then 'cpu' else backend end as runs from p"""
)
def backend_choice(spark, d):
    """Facts of machines made of events: the server's probe, the backend in the process, and what it falls back to."""
    i, u = F.col("event_id"), F.col("user_id")
    probe = backends.server_probe(i % 7 != 0, i % 5 != 0, F.when(i % 11 == 0, None).otherwise(i % 3 != 0), u % 4 == 0, F.when(i % 13 != 0, i * 37 % 6000), F.lit(None).cast("int"))
    forced = F.when(i % 6 == 0, "GPU ").when(i % 6 == 1, "openvino").otherwise("auto")
    chosen = backends.in_process(forced, F.when(u % 2 == 0, "gpu").otherwise("cpu"), u % 3)
    loads = F.when(i % 9 == 0, F.array().cast("array<string>")).when(i % 9 < 5, F.array(F.lit("cpu"))).otherwise(F.array(*map(F.lit, backends.FORCED)))
    found = table(spark, d, "events").select(i.alias("machine"), probe.alias("p"), chosen.alias("backend"), loads.alias("loads"))
    return found.select("machine", "p.ok", "p.reason", "backend", backends.degraded(F.col("backend"), F.col("loads")).alias("runs"))


@query(
    """select case when part_key % 4 = 0 then null else 'ok' end as status, 'hybrid' as engine, part_key as pages, null::varchar as total_time, null::varchar as issues, 'out/' || part_key || '.md' as output,
        case when part_key % 4 = 0 then 'failed' end as error from (select p_partkey as part_key from part)"""
)
def tool_fields(spark, d):
    """Reports made of parts: six fields, absent ones null, an error passed through."""
    k = F.col("p_partkey")
    made = table(spark, d, "part").select(
        F.when(k % 4 != 0, "ok").alias("status"), F.lit("hybrid").alias("engine"), k.alias("pages"), F.concat(F.lit("out/"), k.cast("string"), F.lit(".md")).alias("output"),
        F.when(k % 4 == 0, "failed").alias("error"), F.lit(1).alias("host"),
    )
    return extract.tool_result(made)


@query("select to_json({'doc_id': doc_id, 'source': source, 'text': text})::varchar as json from documents where text is not null and source is not null")
def json_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text").where("text is not null and source is not null")
    return report.as_json(docs)
