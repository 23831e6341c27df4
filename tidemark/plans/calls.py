"""Queries over tool calls, requests and paths, staged from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning, paths
from ..functions.commands import VERIFICATION
from ..operators import calls as C
from .staging import dealt, table

NAMES = ("Read", "Edit", "Bash", "Grep", "Task", "Write", "Glob", "apply_patch")
COMMANDS = (
    "pytest -q && git diff", "rg TODO | head -5", "FOO=secret make build", "cat /etc/passwd", "git commit -m _", "7z x Odd_Name", "ls -la src/a.py ; echo Hi", "--token=abc run", "find . -name _",
)
#: each command with the rules applied once more, by hand; {0} stands for the hash of /etc/passwd
AGAIN = (
    "pytest -q && git diff", "rg _ | head -5", "FOO= make build", "cat <outside>/{0}", "git commit -m _", "7z x _", "ls -la src/a.py ; echo _", "--token run", "find _ -name _",
)
SHELLED = ("bash -lc 'pytest -q'", "/bin/zsh -c ls", "ssh -c 'x'", "sh -c \"make all\"", "pytest -q", "bash script.sh", "bash -l 'x'", "dash -ec 'a && b'")
BARE = ("pytest -q", "ls", "ssh -c 'x'", "make all", "pytest -q", "bash script.sh", "bash -l 'x'", "a && b")


def _pick(values, number):
    return F.element_at(F.lit(list(values)), (number % len(values) + 1).cast("int"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def staged(spark, d):
    """Line items as calls: their order is the capture; fields by their numbers, some of them unknown."""
    k = F.col("l_partkey")
    null = F.lit(None)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("n"), k.alias("k"), _pick(NAMES, k).alias("name"),
        F.when(k % 5 == 0, "test").when(k % 5 == 1, "shell").when(k % 5 == 2, "vcs").otherwise(null).alias("category"), F.when(k % 7 == 0, "file_change").alias("item"),
        _pick(COMMANDS, k).alias("command"), F.when(k % 6 == 0, True).when(k % 6 == 1, False).alias("denied"), F.when(k % 4 == 0, k % 8 == 0).alias("success"),
        (k % 9 == 0).alias("failure"), F.when(k % 3 != 0, k % 2 == 0).alias("is_error"), (k % 11 == 0).alias("masked"), F.when(k % 10 < 3, (k % 10).cast("int")).alias("exit_code"),
        F.when(k % 13 == 0, "").when(k % 4 != 0, F.concat(F.lit("exec-"), k % 50)).alias("use_id"), F.when(k % 3 == 0, F.concat(F.lit("exec-"), k % 50)).alias("call"), F.concat(F.when(k % 2 == 0, "exec-").otherwise("item-"), k % 50).alias("item_id"),
        F.when(k % 5 != 0, k % 1000).alias("input_tokens"), F.when(k % 7 != 0, k % 100).alias("output_tokens"), F.when(k % 3 == 0, k % 10).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_creation_tokens"),
        F.when(k % 4 == 1, F.concat(F.lit("agent:built:a"), k % 3)).when(k % 4 == 2, "repl").alias("source"), F.when(k % 9 == 1, F.concat(F.lit("a"), k % 3)).when(k % 9 == 2, "").alias("agent_name"),
    )


STAGED = f"""st AS (SELECT l_orderkey AS capture_id, l_linenumber AS n, l_partkey AS k, {_listed(NAMES)}[l_partkey % {len(NAMES)} + 1] AS name,
  CASE l_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'shell' WHEN 2 THEN 'vcs' END AS category, CASE WHEN l_partkey % 7 = 0 THEN 'file_change' END AS item,
  {_listed(COMMANDS)}[l_partkey % {len(COMMANDS)} + 1] AS command, CASE l_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS denied, CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 8 = 0 END AS success,
  l_partkey % 9 = 0 AS failure, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 2 = 0 END AS is_error, l_partkey % 11 = 0 AS masked, CASE WHEN l_partkey % 10 < 3 THEN (l_partkey % 10)::INTEGER END AS exit_code,
  CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 4 <> 0 THEN 'exec-' || (l_partkey % 50) END AS use_id, CASE WHEN l_partkey % 3 = 0 THEN 'exec-' || (l_partkey % 50) END AS call,
  CASE WHEN l_partkey % 2 = 0 THEN 'exec-' ELSE 'item-' END || (l_partkey % 50) AS item_id,
  CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 1000 END AS input_tokens, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 100 END AS output_tokens, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 10 END AS cache_read_tokens,
  CASE WHEN l_partkey % 4 = 1 THEN 'agent:built:a' || (l_partkey % 3) WHEN l_partkey % 4 = 2 THEN 'repl' END AS source, CASE WHEN l_partkey % 9 = 1 THEN 'a' || (l_partkey % 3) WHEN l_partkey % 9 = 2 THEN '' END AS agent_name
  FROM lineitem)"""
VERIFYING = ", ".join(f"'{v}'" for v in VERIFICATION)


def q_tool_type(spark, d):
    r = F.col("denied")
    return staged(spark, d).select("capture_id", "n", C.tool_type(F.col("name"), F.col("category"), r, VERIFICATION).alias("by_tool"), C.item_type(F.col("name"), F.col("item"), F.col("category"), F.col("command"), VERIFICATION).alias("by_item"))


def q_tool_outcome(spark, d):
    o = C.outcome(F.col("denied"), F.col("success"), F.col("failure"), F.col("is_error"), F.col("masked"))
    rows = staged(spark, d).withColumn("o", o)
    return rows.select("capture_id", "n", "o.outcome", "o.executed", "o.exit_masked", "o.success", C.exit_outcome(F.col("success"), F.col("exit_code")).alias("by_exit"))


def q_outcome_word(spark, d):
    return staged(spark, d).select("capture_id", "n", C.outcome_word(F.col("exit_code"), F.col("success"), F.col("is_error"), F.col("masked")).alias("word"))


def q_execution_groups(spark, d):
    return C.by_execution(staged(spark, d), ["use_id", "call", "item_id"], [F.count("*").alias("rows"), F.min("n").alias("first_n")])


def q_unshell(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.unshell(_pick(SHELLED, F.col("o_orderkey"))).alias("command"))


def q_renormalise(spark, d):
    once = staged(spark, d).select("capture_id", "n", "command", C.renormalise(F.col("command")).alias("again"))
    return once.select("capture_id", "n", "again", (F.col("again") != F.col("command")).alias("changed"), (C.renormalise(F.col("again")) == F.col("again")).alias("stable"))


def q_durations(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", C.duration_ms(F.when(F.col("l_partkey") % 5 != 0, F.col("l_suppkey")), F.col("l_partkey").cast("long") * 1_234_567 % 1_000_000_000).alias("ms"))


TYPED = ("12", "-7", "1.5", "1e3", "", "abc", "0x10", "9999999999999999999", "1.", " 4", "inf")


def q_typed_reads(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", _pick(TYPED, F.col("o_orderkey")).alias("t"))
    return rows.select("o_orderkey", C.whole(F.col("t")).alias("whole"), C.number(F.col("t")).alias("number"), C.text_or_null(F.col("t")).alias("text"), C.typed_number(F.col("t"), F.when(F.col("o_orderkey") % 2 == 0, "size").otherwise("enum")).alias("size"))


def q_usage_spellings(spark, d):
    """Two spellings of a counter, and the request's output count from the surfaces that state one."""
    rows = staged(spark, d).withColumn("count", C.usage(F.col("output_tokens"), F.col("cache_read_tokens")))
    return C.output_tokens(rows, ["capture_id"], ["n", "k"], F.col("name") == "Task", F.col("count"))


def q_search_ops(spark, d):
    return staged(spark, d).groupBy("capture_id").agg(F.count_if(C.is_search(F.col("name"), F.col("command"))).alias("search_ops"))


def _requests(spark, d):
    return staged(spark, d).withColumn("agent", C.agent_of(F.col("agent_name"), F.col("source")))


def _agents(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"))
    return e.select("capture_id", F.explode(F.lit(["a0", "a1", "a2"])).alias("agent_type")).where("pmod(capture_id + cast(substr(agent_type, 2) as int), 2) = 0")


def q_attributed_tokens(spark, d):
    return C.attributed(_requests(spark, d), _agents(spark, d)).drop("attributed_cache_creation_tokens")


def q_subagent_tokens(spark, d):
    return C.subagent_tokens(C.attributed(_requests(spark, d), _agents(spark, d)))


def q_output_or_session_total(spark, d):
    total = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("capture_id"), F.explode(F.array(F.struct(F.lit(1).alias("position"), F.col("o_custkey").alias("total")), F.struct(F.lit(2).alias("position"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 1).alias("total")))).alias("x")).select("capture_id", "x.*")
    return C.total_or_session(staged(spark, d), "capture_id", F.col("output_tokens"), total)


def q_turn_totals(spark, d):
    rows = staged(spark, d).where("name in ('Task', 'Bash')").withColumn("place", F.struct("n", "k"))
    return C.turn_totals(rows, ["capture_id"], "name", "place", ["input_tokens", "cache_read_tokens"], "Task", "Bash")


def q_unit_values(spark, d):
    v = F.round("l_discount", 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.unit_value(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("double")).otherwise(v.cast("double")), F.when(F.col("l_linenumber") % 2 == 0, "tokens").otherwise("ratio")).alias("value"))


WHERE = ("/repo/src/{0}.py", "src/./x/../{0}.py", "~/notes/{0}", "/repo", "/repository/{0}", "  ", "/repo/../etc/{0}", "./{0}")


def q_relativize(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.replace(_pick(WHERE, F.col("p_partkey")), F.lit("{0}"), F.col("p_partkey").cast("string")).alias("path"))
    return p.select("p_partkey", paths.relativize(F.col("path"), F.lit("/repo"), F.lit("/home/u")).alias("inside"), paths.relativize(F.col("path"), F.lit(None).cast("string"), F.lit("/home/u")).alias("without"))


def q_prose_paths(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("failed at /repo/a/"), F.col("p_partkey"), F.lit(".py, see ~/log. Or http://x/y and a/b (/tmp/z)!")).alias("text"))
    return p.select("p_partkey", paths.prose(F.col("text"), F.lit("/repo"), F.lit("/home/u")).alias("text"), paths.prose(F.col("text"), F.lit("/repo"), F.lit("/home/u"), 0).alias("hidden"))


def q_clean_json(spark, d):
    text = F.concat(F.lit('{"a":"'), F.col("p_partkey"), F.lit('","prompt":"secret","k":"sk-abcdefghijklmnopqrstuv","deep":[[[[[[["x"]]]]]]],"n":'), F.col("p_size"), F.lit("}"))
    p = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.lit("{not json")).otherwise(text).alias("text"))
    r = p.withColumn("r", cleaning.clean_json(F.col("text"), "f", "scalar", ("prompt",)))
    return r.select("p_partkey", F.col("r.payload").alias("payload"), F.array_join("r.notes", ";").alias("notes"))


def q_repeated_keys(spark, d):
    text = F.concat(F.lit('{"a":{"b":1,'), F.when(F.col("p_partkey") % 3 == 0, F.lit('"b":2,')).otherwise(F.lit('"c":2,')), F.lit('"d":3},"a":'), F.col("p_partkey"), F.lit("}"))
    return table(spark, d, "part").select("p_partkey", F.array_join(cleaning.repeated_keys(F.when(F.col("p_partkey") % 7 != 0, text)), ",").alias("keys"))


READERS = ", ".join(f"'{h}'" for h in C.READ_HEADS)
SQL = {
    "tool_type": f"""WITH {STAGED} SELECT capture_id, n, CASE WHEN denied THEN 'tool_call' WHEN category IN ({VERIFYING}) THEN 'verification_run' WHEN name IN ('Edit', 'Write') THEN 'file_edit'
  WHEN name IN ('Read', 'Grep', 'Glob') THEN 'file_read' WHEN name = 'Bash' OR category IS NOT NULL THEN 'command' ELSE 'tool_call' END AS by_tool,
  CASE WHEN name = 'apply_patch' OR item IS NOT NULL THEN 'file_edit' WHEN category IN ({VERIFYING}) THEN 'verification_run' WHEN category = 'shell' AND k % 9 IN (1, 3, 6, 8) THEN 'file_read'
  WHEN category IS NOT NULL THEN 'command' ELSE 'tool_call' END AS by_item FROM st""",
    "tool_outcome": f"""WITH {STAGED} SELECT capture_id, n, CASE WHEN denied THEN 'refused' ELSE 'executed' END AS outcome, NOT coalesce(denied, false) AS executed,
  CASE WHEN NOT coalesce(denied, false) AND masked THEN true END AS exit_masked,
  CASE WHEN NOT coalesce(denied, false) THEN coalesce(success, CASE WHEN failure THEN false END, NOT is_error) END AS success, coalesce(success, exit_code = 0) AS by_exit FROM st""",
    "outcome_word": f"""WITH {STAGED}, w AS (SELECT *, CASE WHEN exit_code IS NOT NULL THEN CASE WHEN exit_code = 0 THEN 'ok' ELSE 'failed' END WHEN success IS NOT NULL THEN CASE WHEN success THEN 'ok' ELSE 'failed' END
  WHEN is_error THEN 'failed' WHEN NOT is_error THEN 'ok' END AS w FROM st) SELECT capture_id, n, CASE WHEN masked THEN CASE WHEN w IS NULL THEN 'check masked' ELSE w || ', check masked' END ELSE w END AS word FROM w""",
    "execution_groups": f"""WITH {STAGED}, e AS (SELECT *, coalesce(nullif(use_id, ''), nullif(call, ''), nullif(item_id, '')) AS execution FROM st)
  SELECT capture_id, execution, count(*) AS rows, min(n) AS first_n FROM e WHERE starts_with(execution, 'exec-') GROUP BY ALL""",
    "unshell": f"SELECT o_orderkey, {_listed(BARE)}[o_orderkey % {len(BARE)} + 1] AS command FROM orders",
    "renormalise": f"""WITH {STAGED}, a AS (SELECT *, replace({_listed(AGAIN)}[k % {len(AGAIN)} + 1], '{{0}}', substr(sha256('/etc/passwd'), 1, 8)) AS again FROM st)
  SELECT capture_id, n, again, again <> command AS changed, true AS stable FROM a""",
    "durations": "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN l_suppkey::BIGINT * 1000 + (l_partkey::BIGINT * 1234567 % 1000000000) // 1000000 END AS ms FROM lineitem",
    "typed_reads": f"""WITH t AS (SELECT o_orderkey, o_orderkey % {len(TYPED)} AS i FROM orders)
  SELECT o_orderkey, CASE i WHEN 0 THEN 12 WHEN 1 THEN -7 END::BIGINT AS whole, CASE i WHEN 0 THEN 12 WHEN 1 THEN -7 WHEN 2 THEN 1.5 WHEN 3 THEN 1000 WHEN 7 THEN 1e19 WHEN 8 THEN 1 END::DOUBLE AS number,
  nullif({_listed(TYPED)}[i + 1], '') AS text, CASE WHEN o_orderkey % 2 = 0 THEN CASE i WHEN 0 THEN 12 WHEN 1 THEN -7 WHEN 2 THEN 1.5 WHEN 3 THEN 1000 WHEN 7 THEN 1e19 WHEN 8 THEN 1 END END::DOUBLE AS size FROM t""",
    "usage_spellings": f"""WITH {STAGED}, c AS (SELECT *, coalesce(output_tokens, cache_read_tokens) AS c FROM st)
  SELECT capture_id, arg_min(c, (n, k)) FILTER (c IS NOT NULL AND name <> 'Task') AS output_tokens, arg_min(c, (n, k)) FILTER (c IS NOT NULL AND name = 'Task') AS snapshot FROM c GROUP BY capture_id""",
    "search_ops": f"WITH {STAGED} SELECT capture_id, count(*) FILTER (name IN ('Grep', 'Glob') OR len(list_intersect(string_split(command, ' '), ['rg', 'grep', 'find'])) > 0) AS search_ops FROM st GROUP BY capture_id",
}
ATTRIBUTED = f"""{STAGED}, rq AS (SELECT *, coalesce(nullif(agent_name, ''), CASE WHEN starts_with(source, 'agent:') THEN regexp_extract(source, '[^:]*$') END) AS agent FROM st),
  ag AS (SELECT o_orderkey AS capture_id, 'a' || j AS agent_type FROM orders, (SELECT unnest(range(3)) AS j) WHERE (o_orderkey + j) % 2 = 0),
  att AS (SELECT ag.capture_id, agent_type, nullif(count(rq.capture_id), 0) AS attributed_requests, sum(input_tokens)::BIGINT AS attributed_input_tokens, sum(output_tokens)::BIGINT AS attributed_output_tokens,
    sum(cache_read_tokens)::BIGINT AS attributed_cache_read_tokens, CASE WHEN count(rq.capture_id) > 0 THEN (coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) + coalesce(sum(cache_read_tokens), 0))::BIGINT END AS attributed_total
    FROM ag LEFT JOIN rq ON rq.capture_id = ag.capture_id AND agent = agent_type GROUP BY ALL)"""
SQL |= {
    "attributed_tokens": f"WITH {ATTRIBUTED} SELECT * FROM att",
    "subagent_tokens": f"""WITH {ATTRIBUTED} SELECT capture_id, sum(attributed_total)::BIGINT AS subagent_tokens,
  CASE WHEN count(attributed_total) = 0 THEN 'unavailable' WHEN count(attributed_total) < count(*) THEN 'partial' ELSE 'observed' END AS coverage FROM att GROUP BY capture_id""",
    "output_or_session_total": f"""WITH {STAGED}, t AS (SELECT o_orderkey AS capture_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS total FROM orders WHERE o_orderkey % 3 <> 0),
  s AS (SELECT capture_id, CASE WHEN count(output_tokens) = count(*) THEN sum(output_tokens) END::BIGINT AS own FROM st GROUP BY capture_id)
  SELECT s.capture_id, coalesce(own, total)::BIGINT AS output_tokens, CASE WHEN own IS NOT NULL THEN 'observed' WHEN total IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS coverage FROM s LEFT JOIN t USING (capture_id)""",
    "turn_totals": f"""WITH {STAGED}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY name = 'Task' DESC, n DESC, k DESC) AS nth FROM st WHERE name IN ('Task', 'Bash'))
  SELECT capture_id, name AS usage_source, input_tokens, cache_read_tokens FROM r WHERE nth = 1""",
    "unit_values": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity)::BIGINT::VARCHAR ELSE round(l_discount, 2)::DOUBLE::VARCHAR END AS value FROM lineitem",
    "relativize": """WITH p AS (SELECT p_partkey, p_partkey % 8 AS i FROM part)
  SELECT p_partkey, CASE i WHEN 0 THEN 'src/' || p_partkey || '.py' WHEN 1 THEN 'src/' || p_partkey || '.py' WHEN 2 THEN '<outside>/' || substr(sha256('/home/u/notes/' || p_partkey), 1, 8) WHEN 3 THEN '.'
    WHEN 4 THEN '<outside>/' || substr(sha256('/repository/' || p_partkey), 1, 8) WHEN 6 THEN '<outside>/' || substr(sha256('/etc/' || p_partkey), 1, 8) WHEN 7 THEN p_partkey::VARCHAR END AS inside,
  CASE i WHEN 0 THEN '<outside>/' || substr(sha256('/repo/src/' || p_partkey || '.py'), 1, 8) WHEN 1 THEN 'src/./x/../' || p_partkey || '.py' WHEN 2 THEN '<outside>/' || substr(sha256('/home/u/notes/' || p_partkey), 1, 8)
    WHEN 3 THEN '<outside>/' || substr(sha256('/repo'), 1, 8) WHEN 4 THEN '<outside>/' || substr(sha256('/repository/' || p_partkey), 1, 8) WHEN 6 THEN '<outside>/' || substr(sha256('/etc/' || p_partkey), 1, 8) WHEN 7 THEN './' || p_partkey END AS without FROM p""",
    "prose_paths": """SELECT p_partkey, 'failed at a/' || p_partkey || '.py, see <outside>/' || substr(sha256('/home/u/log'), 1, 8) || '. Or http://x/y and a/b (<outside>/' || substr(sha256('/tmp/z'), 1, 8) || ')!' AS text,
  'failed at <path>, see <path>. Or http://x/y and a/b (<path>)!' AS hidden FROM part""",
    "clean_json": """SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN '{"a":"' || p_partkey || '","deep":[[[[[[]]]]]],"k":"<redacted:1>","n":' || p_size || '}' END AS payload,
  CASE WHEN p_partkey % 10 = 0 THEN 'dropped:f:json' ELSE 'dropped:f.prompt:refused;dropped:f:depth;redacted:f:secret' END AS notes FROM part""",
    "repeated_keys": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'a,b' ELSE 'a' END END AS keys FROM part",
}
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
