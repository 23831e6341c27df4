"""Queries over mixed surfaces and payloads of many kinds, staged from the events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import commands as C
from ..sources import dispatch as D
from .calls import _listed, _pick
from .staging import dealt, table

ROUTES = (
    ("claude", "otel_logs"), ("claude", "otel_metrics"), ("claude", "hook"), ("claude", "stream"), ("claude", "transcript"), ("codex", "exec_json"), ("codex", "stream"), ("codex", "rollout"), ("codex", "hook"), ("codex", "transcript"), (None, "hook"),
)
#: bodies by route; {e} is the event's id, {u} its user's
BODIES = (
    '{"resourceLogs":[{"resource":{"attributes":[{"key":"session.id","value":{"stringValue":"s{u}"}}]},"scopeLogs":[{"logRecords":[{"attributes":[{"key":"event.name","value":{"stringValue":"api_request"}},{"key":"n","value":{"intValue":"{e}"}}]},7,{"body":{"stringValue":"said"}}]}]},"odd"]}',
    '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"tokens","unit":"1","sum":{"dataPoints":[{"asInt":"{e}","attributes":[{"key":"session.id","value":{"stringValue":"s{u}"}}]},{"asDouble":1.5}]}}]}]}]}',
    '{"session_id":"s{u}","hook_event_name":"PreToolUse","tool_name":"Bash","tool_use_id":"t{e}"}',
    '{"type":"assistant","session_id":"s{u}","message":{"model":"m","usage":{"input_tokens":{e},"output_tokens":2},"content":[{"type":"text","text":"kept out"},{"type":"tool_use","id":"t{e}","name":"Edit"},"odd"]}}',
    '{"type":"user","sessionId":"s{u}","uuid":"u{e}","timestamp":"2024-01-02T03:04:05Z","message":{"content":[{"type":"tool_result","tool_use_id":"t{e}","is_error":true}]}}',
    '{"type":"item.completed","thread_id":"s{u}","item":{"id":"i{e}","type":"file_change","changes":{"a.py":{"kind":"add"},"b.py":{"kind":"update"}}}}',
    '{"type":"turn.completed","thread_id":"s{u}","usage":{"input_tokens":{e},"cached_input_tokens":10,"output_tokens":3}}',
    '{"timestamp":"2024-01-02T03:04:05Z","type":"session_meta","payload":{"id":"s{u}","cwd":"/r"}}',
    '{"session_id":"s{u}"}', '{"type":"user"}', '{"hook_event_name":"Stop"}',
)


def _mixed(spark, d):
    e, k = F.col("event_id"), F.col("event_id") % len(ROUTES)
    body = F.replace(F.replace(_pick(BODIES, e), F.lit("{e}"), e.cast("string")), F.lit("{u}"), F.col("user_id").cast("string"))
    broken = F.when(e % 13 == 5, F.substring(body, F.lit(1), F.length(body) - 1)).when(e % 13 == 7, F.lit("[1,2]")).when(e % 13 != 9, body)
    routes = [F.lit(list(x)) for x in (["" if p is None else p for p, _ in ROUTES], [s for _, s in ROUTES])]
    return dealt(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", F.nullif(F.element_at(routes[0], (k + 1).cast("int")), F.lit("")).alias("provider"), F.element_at(routes[1], (k + 1).cast("int")).alias("surface"), broken.alias("body"))


def q_mixed_surfaces(spark, d):
    """One pass over all of them: observations and letters."""
    found = D.dispatch(_mixed(spark, d))
    entries = F.array_sort(F.map_entries("payload"))
    told = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("event_id", "n", "session", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), told.alias("payload"), "why")


def q_mixed_letters(spark, d):
    """Letters by surface and reason, beside how many bodies were read."""
    found = D.dispatch(_mixed(spark, d)).where("n is null or n = 0")
    return found.groupBy("provider", "surface", "why").agg(F.count("*").alias("bodies"))


PAYLOAD = '{"tokens":{p},"cwd":"/repo/a/{p}","cmd":"cd /repo && KEY=v uv run pytest tests/{p}.py","word":"w{p}","note":{"k":"TOKEN={x}","prompt":"hidden","l":[{p},null,"t"]},"files":{"/repo/z":{p},"/etc/x":1},"extra":1}'
FIELDS = {"tokens": "size", "cwd": "path", "cmd": "command", "word": "enum", "note": "scalar", "files": "path"}


def q_clean_kinds(spark, d):
    """Payloads of every kind of field; each third states its tokens as text, each seventh is a list."""
    p = F.col("p_partkey")
    text = F.replace(F.replace(F.lit(PAYLOAD), F.lit("{p}"), p.cast("string")), F.lit("{x}"), F.lit("x" * 40))
    text = F.when(p % 3 == 0, F.regexp_replace(text, r'"tokens":(\d+)', '"tokens":"$1"')).otherwise(text)
    rows = dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.when(p % 7 == 0, F.lit("[1]")).otherwise(text).alias("t"))
    rules = cleaning.Rules(FIELDS, refused=("prompt",), repo=F.lit("/repo"), home=F.lit("/home/u"))
    r = rows.select("p_partkey", cleaning.clean_payload(F.try_parse_json("t"), rules).alias("r"))
    return r.select("p_partkey", "r.payload", F.array_join("r.notes", ";").alias("notes"))


#: raw lines and their normal forms; {p} is a number
FORMS = (
    ("FOO=bar uv run pytest tests/x{p}.py -k 'my name'", "FOO= uv run pytest tests/x{p}.py -k _"), ("git commit -m 'secret {p}'", "git commit -m _"), ('echo "open {p}', "echo _"), ("ls;pwd", "ls ; pwd"),
    ("A=1 B=2", "A= B="), ("cd a/{p}\nuv run pytest", "cd a/{p} ; uv run pytest"), ("uv run ruff check . &&\n uv run pytest", "uv run ruff check . && uv run pytest"),
    ("python3 x.py <<'PY'\nimport os; print(\"it's {p}\")\nPY\nuv run pytest -q", "python3 x.py << _ _ ; uv run pytest -q"), ("cat <<a <<-b\nbody 'a\na\n\tbody b\n\tb\nls", "cat << a _ << -b _ ; ls"),
    ('git commit -m "two\nlines" && git push origin main', "git commit -m _ && git push origin _"), ("# it's fine\nls", "ls"), ("echo x > out/{p} 2>&1", "echo x > out/{p} _ >& _"), ("cat <<< word | wc -l", "cat <<< word | wc -l"),
    ("npm run build --watch=1 extra words", "npm run build --watch _ _"), ("poetry run python -m mypy src/", "poetry run python -m mypy src/"), ("/usr/bin/python3 a/b.py ..", "python3 a/b.py .."), ("ls \\\n -la", "ls -la"),
    ("(cd a && make)", "( cd a && make )"), ('git commit -m "open and {p}', "git commit _"), ('a "b\\"c {p}" d', "a _ d"), ("make -j8 all {p}", "make -j8 all _"), ("echo 'a;b' ; true", "echo _ ; true"), ("X=1 Y='a b' run --k=v", "X= Y= run --k"),
    ("ls | grep -v foo || true", "ls | grep -v foo || true"), ("sleep 5 &", "sleep _ &"), ("\n\nls\n\npwd\n", "ls ; pwd"), ("cat <<'E'\nx && y\nE", "cat << _ _"), ('echo "<<E" && ls\nE', "echo _ && ls ; E"), ("npx jest --ci", "npx jest --ci"),
    ("go test ./pkg/{p}", "go test ./pkg/{p}"), ("docker build -t x:{p} .", "docker build -t _ ."), ("", ""),
)


def q_normal_forms(spark, d):
    p = F.col("p_partkey")
    line = F.replace(_pick([a for a, _ in FORMS], p), F.lit("{p}"), p.cast("string"))
    return dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", C.normalise(line).alias("form"))


FLAGS = ("--model", "-m")


def q_argument_values(spark, d):
    """Arguments of a launch: the last of a flag wins, settings lose their quotes, a posture comes from a switch, a flag or a setting."""
    k = F.col("o_orderkey")
    some = lambda c, *words: F.when(c, F.array(*[F.lit(w) if isinstance(w, str) else w for w in words])).otherwise(F.array().cast("array<string>"))
    argv = F.concat(
        F.array(F.lit("run")), some(k % 2 == 0, "--model", F.concat(F.lit("a"), k % 5)), some(k % 3 == 0, F.concat(F.lit("-m=b"), k % 7)), some(k % 5 == 0, "-c", 'effort="high"'), some(k % 7 == 0, "--config", "effort='low'"),
        some(k % 11 == 0, "--full-auto"), some(k % 4 == 1, "--sandbox", "read-only"), some(k % 6 == 5, "-c", "sandbox_mode=off"), some(k % 13 == 0, "--model"),
    )
    a = table(spark, d, "orders").select("o_orderkey", argv.alias("argv"))
    return a.select("o_orderkey", C.argument_of(F.col("argv"), FLAGS).alias("model"), C.setting_of(F.col("argv"), "effort").alias("effort"), C.posture_of(F.col("argv"), ("--yolo", "--full-auto"), ("--sandbox",), "sandbox_mode").alias("posture"))


P = "provider = '{0}' AND surface = '{1}'"
MIXED = f"""m AS (SELECT event_id, user_id, event_id % {len(ROUTES)} AS i, event_id::VARCHAR AS e, 's' || user_id AS s,
  {_listed([p or "" for p, _ in ROUTES])}[event_id % {len(ROUTES)} + 1] AS p, {_listed([s for _, s in ROUTES])}[event_id % {len(ROUTES)} + 1] AS surface,
  CASE WHEN event_id % {len(ROUTES)} >= 9 THEN 'surface' WHEN event_id % 13 IN (5, 9) THEN 'json' WHEN event_id % 13 = 7 THEN 'no_object' WHEN event_id % {len(ROUTES)} = 8 THEN 'empty' END AS why FROM events)"""
FRESH = "CASE WHEN event_id >= 10 THEN 'fresh=' || (event_id - 10) || ';' ELSE '' END"
SQL = {
    "mixed_surfaces": f"""WITH {MIXED}, o AS (SELECT *, unnest(CASE WHEN why IS NOT NULL THEN [{{'n': NULL::INT, 's': NULL, 'k': NULL, 'a': NULL, 'x': NULL}}] ELSE CASE i
    WHEN 0 THEN [{{'n': 0, 's': s, 'k': 'claude.otel.api_request', 'a': NULL, 'x': 'n=' || e}}, {{'n': 1, 's': s, 'k': 'claude.otel.said', 'a': NULL, 'x': ''}}]
    WHEN 1 THEN [{{'n': 0, 's': s, 'k': 'claude.metric.tokens', 'a': NULL, 'x': 'aggregation=sum;unit=1;value=' || e || '.0'}}, {{'n': 1, 's': NULL, 'k': 'claude.metric.tokens', 'a': NULL, 'x': 'aggregation=sum;unit=1;value=1.5'}}]
    WHEN 2 THEN [{{'n': 0, 's': s, 'k': 'claude.hook.pre_tool_use', 'a': NULL, 'x': 'tool=Bash;tool_use_id=t' || e}}]
    WHEN 3 THEN [{{'n': 0, 's': s, 'k': 'claude.stream.assistant', 'a': NULL, 'x': 'input=' || e || ';model=m;output=2;text_blocks=1;thinking_blocks=0'}}, {{'n': 1, 's': s, 'k': 'claude.stream.tool_use', 'a': NULL, 'x': 'call=t' || e || ';name=Edit'}}]
    WHEN 4 THEN [{{'n': 0, 's': s, 'k': 'claude.transcript.user', 'a': '2024-01-02 03:04:05', 'x': 'text_blocks=0;thinking_blocks=0;uuid=u' || e}},
      {{'n': 1, 's': s, 'k': 'claude.transcript.tool_result', 'a': '2024-01-02 03:04:05', 'x': 'call=t' || e || ';is_error=true'}}]
    WHEN 5 THEN [{{'n': 0, 's': s, 'k': 'codex.exec.item.completed.file_change', 'a': NULL, 'x': 'id=i' || e}}, {{'n': 1, 's': s, 'k': 'codex.exec.file', 'a': NULL, 'x': 'change=add;item=i' || e || ';path=a.py'}},
      {{'n': 2, 's': s, 'k': 'codex.exec.file', 'a': NULL, 'x': 'change=update;item=i' || e || ';path=b.py'}}]
    WHEN 6 THEN [{{'n': 0, 's': s, 'k': 'codex.exec.turn.completed', 'a': NULL, 'x': 'cached=10;' || {FRESH} || 'output=3'}}]
    ELSE [{{'n': 0, 's': s, 'k': 'codex.rollout.session_meta', 'a': '2024-01-02 03:04:05', 'x': 'cwd=/r;id=' || s}}] END END) AS u FROM m)
  SELECT event_id, u.n AS n, u.s AS session, u.k AS kind, u.a AS at, u.x AS payload, why FROM o""",
    "mixed_letters": f"WITH {MIXED} SELECT nullif(p, '') AS provider, surface, why, count(*) AS bodies FROM m GROUP BY ALL",
    "clean_kinds": """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN '{"cmd":"cd . && KEY= uv run pytest tests/' || p_partkey || '.py","cwd":"a/' || p_partkey || '","files":{"<outside>/' || substr(sha256('/etc/x'), 1, 8) || '":1,"z":' || p_partkey
    || '},"note":{"k":"TOKEN=<redacted:1>","l":[' || p_partkey || ',null,"t"]}' || CASE WHEN p_partkey % 3 <> 0 THEN ',"tokens":' || p_partkey ELSE '' END || ',"word":"w' || p_partkey || '"}' END AS payload,
  CASE WHEN p_partkey % 7 = 0 THEN 'dropped:payload:no_object' ELSE 'dropped:extra:unknown;dropped:note.prompt:refused' || CASE WHEN p_partkey % 3 = 0 THEN ';dropped:tokens:not_a_number' ELSE '' END || ';redacted:note:secret' END AS notes FROM part""",
    "normal_forms": f"SELECT p_partkey, replace({_listed([b for _, b in FORMS])}[p_partkey % {len(FORMS)} + 1], '{{p}}', p_partkey::VARCHAR) AS form FROM part",
    "argument_values": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b' || o_orderkey % 7 WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey % 5 END AS model,
  CASE WHEN o_orderkey % 7 = 0 THEN 'low' WHEN o_orderkey % 5 = 0 THEN 'high' END AS effort,
  CASE WHEN o_orderkey % 11 = 0 THEN '--full-auto' WHEN o_orderkey % 4 = 1 THEN 'read-only' WHEN o_orderkey % 6 = 5 THEN 'off' END AS posture FROM orders""",
}
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
