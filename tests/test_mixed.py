"""Mixed surfaces, cleaning by kinds, command forms and arguments on odd input."""

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.functions import commands as K
from tidemark.sources import dispatch as D


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_every_body_gives_observations_or_one_letter(spark):
    bodies = [
        ("claude", "hook", '{"hook_event_name":"Stop","session_id":"s"}', None), ("claude", "hook", '{"session_id":"s"}', "empty"), ("claude", "hook", "{bad", "json"), ("claude", "hook", None, "json"), ("claude", "hook", "", "json"),
        ("claude", "hook", '{"a":1,"a":2}', "json"), ("claude", "hook", '"text"', "no_object"), ("claude", "nowhere", "{}", "surface"), (None, "hook", "{}", "surface"), ("codex", "transcript", "{}", "surface"),
        ("claude", "otel_logs", '{"resourceLogs":[]}', "empty"), ("claude", "otel_logs", '{"resourceLogs":{"scopeLogs":1}}', "empty"), ("claude", "otel_logs", '{"resourceLogs":[1,{"scopeLogs":[null,{"logRecords":[[],{}]}]}]}', None),
        ("claude", "otel_metrics", '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"m","histogram":{"dataPoints":[{"sum":2.5,"timeUnixNano":"1000000000"}]},"gauge":7}]}]}]}', None),
        ("codex", "stream", '{"type":"item.completed","item":{"type":"reasoning"}}', "empty"), ("codex", "exec_json", '{"type":"t","thread_id":"x","item":{"changes":[{"path":"p","kind":"add"},3]}}', None),
        ("codex", "rollout", '{"type":"session_meta","payload":{"id":"x"},"timestamp":"not a time"}', None), ("claude", "stream", '{"type":"assistant","message":{"content":"plain"}}', None),
    ]
    rows = spark.createDataFrame([(i, *b[:3]) for i, b in enumerate(bodies)], "id int, provider string, surface string, body string")
    found = D.dispatch(rows)
    got = {r.id: r.why for r in found.collect()}
    assert [got[i] for i in range(len(bodies))] == [b[3] for b in bodies]
    good, letters = D.split_letters(found, "id")
    assert good.select("id").distinct().count() + letters.count() == len(bodies) and letters.columns == ["id", "why", "detail"]
    by = {(r.id, r.n): r for r in good.collect()}
    assert by[12, 0].kind == "claude.otel.unnamed" and by[13, 0].payload == {"aggregation": "histogram", "value": "2.5"} and str(by[13, 0].at) == "1970-01-01 00:00:01"
    assert by[15, 1].payload == {"path": "p", "change": "add"} and (15, 2) not in by and by[16, 0].session == "x" and by[16, 0].at is None and "text_blocks" not in by[17, 0].payload
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Scan") == 1
    assert D.dispatch(rows.limit(0)).count() == 0


def test_kinds_of_fields(spark):
    rules = C.Rules({"n": "size", "p": "path", "c": "command", "e": "enum", "i": "id", "s": "scalar"}, refused=("prompt",), repo=F.lit("/repo"), home=F.lit("/home/u"))
    of = lambda text: one(spark, C.clean_payload(F.try_parse_json("t"), rules), t=text)
    r = of('{"n":[1,"2",3.5],"p":["/repo/a","/repo",""],"c":["git commit -m \\"x y\\"",["ls"]],"e":"' + "e" * 80 + '","i":"' + "i" * 200 + '","s":"' + "s" * 600 + '","u":1,"prompt":"no"}')
    assert r.payload == '{"c":["git commit -m _",[]],"e":"' + "e" * 64 + '","i":"' + "i" * 128 + '","n":[1,3.5],"p":["a","."],"s":"' + "s" * 512 + '"}'
    assert r.notes == ["cut:e:string", "cut:i:string", "cut:s:string", "dropped:c:command_depth", "dropped:n:not_a_number", "dropped:p:empty_path", "dropped:prompt:refused", "dropped:u:unknown"]
    r = of('{"p":{"/repo/x":{"/repo/y":null},"/etc":1},"s":{"b":1,"a":{"prompt":2,"k":"\\u00e9\\n\\"q"}}}')
    assert r.payload.startswith('{"p":{"<outside>/') and r.payload.endswith('"x":{"y":null}},"s":{"a":{"k":"é\\n\\"q"},"b":1}}') and r.notes == ["dropped:s.prompt:refused"]
    r = of('{"s":[' + ",".join(["1"] * 300) + '],"c":null,"n":true}')
    assert r.payload == '{"c":null,"n":true,"s":[' + ",".join(["1"] * 256) + "]}" and r.notes == ["cut:s:items"]
    hidden = C.Rules({"p": "path"}, others="scalar", repo=F.lit("/repo"), level=0)
    r = one(spark, C.clean_payload(F.try_parse_json("t"), hidden), t='{"p":["/repo/a"],"q":{"p":"/x"}}')
    assert (r.payload, r.notes) == ('{"p":[],"q":{"p":"/x"}}', ["dropped:p:path"])
    try:
        C.Rules({"a": "unheard"})
        raise AssertionError
    except ValueError:
        pass


def test_long_commands_and_secrets(spark):
    long = "echo " + "'a' " * 30_000 + "\nx\\ y " * 1000
    assert len(one(spark, K.normalise(F.col("t")), t=long)) == 512
    body = "cat <<E\n" + "it's a line\n" * 50_000 + "E\nls"
    assert one(spark, K.normalise(F.col("t")), t=body) == "cat << _ _ ; ls"
    r = one(spark, K.normal_form(F.col("t")), t="run --key=1 -ghp_abcdefghijklmnopqrstuv /x/y")
    assert r.redacted and "ghp_" not in r.text
    assert one(spark, K.normal_form(F.col("t"), level=0)["text"], t="A=1 /bin/git commit && cd x | ls -l") == "git && cd | ls"
    assert one(spark, K.normal_form(F.col("t"), F.lit("/repo"), F.lit("/home/u"))["text"], t="pytest /repo/tests/ ~/x ../y") == "pytest tests/ <outside>/" + one(spark, F.substring(F.sha2("t", 256), 1, 8), t="/home/u/x") + " <outside>/" + one(
        spark, F.substring(F.sha2("t", 256), 1, 8), t="/y"
    )
