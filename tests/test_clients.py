"""Model calls against a server on this machine that answers as the test says."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lodestone import clients
from lodestone.api import Api
from lodestone.operators import answer, evaluate, verify
from lodestone.plans.engine import Engine, EngineConfig, EngineError


class Server:
    """Answers both wire formats; `say` maps a user prompt to replies, one for each time it is asked."""

    def __init__(self):
        outer, self.seen, self.say = self, [], lambda user, times: "{}"

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                hosted = ":generateContent" in self.path
                user = body["contents"][0]["parts"][0]["text"] if hosted else body["messages"][1]["content"]
                outer.seen.append((self.path, dict(self.headers), body, user))
                text = outer.say(user, sum(x[3] == user for x in outer.seen))
                if hosted:
                    made = {"candidates": [{"content": {"parts": [{"text": text}]}}], "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4, "totalTokenCount": 7}}
                else:
                    made = {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}}
                status = 500 if text == "FAIL" else 200
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps(made).encode())

            def log_message(self, *args):
                pass

        self.http = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    made = Server()
    yield made
    made.http.shutdown()


def test_both_formats(server, monkeypatch):
    server.say = lambda user, times: f"re: {user}"
    local = clients.ChatCompletions("m", server.url, schema='{"type": "object"}')
    got = local("be brief", "hello")
    assert (got.text, got.model, got.input_tokens, got.output_tokens, got.total_tokens) == ("re: hello", "m", 3, 4, 7) and got.latency_ms > 0
    assert server.seen[-1][0] == "/chat/completions" and server.seen[-1][2]["response_format"]["json_schema"]["schema"] == {"type": "object"}
    hosted = clients.GenerateContent("g", server.url, key_variable="TEST_KEY")
    with pytest.raises(RuntimeError, match="TEST_KEY"):
        hosted("s", "u")
    monkeypatch.setenv("TEST_KEY", "secret")
    assert hosted("s", "u").text == "re: u" and {k.lower(): v for k, v in server.seen[-1][1].items()}["x-goog-api-key"] == "secret"
    with pytest.raises(clients.ModelUnavailable):
        clients.ChatCompletions("m", "http://127.0.0.1:9")("s", "u")
    server.say = lambda user, times: "FAIL"
    with pytest.raises(RuntimeError, match="500"):
        local("s", "u")


def test_generator(spark, server):
    server.say = lambda user, times: "It rains [1]."
    asked = spark.createDataFrame([(1, "Rain?")], "query_id int, text string")
    ranked = spark.createDataFrame([(1, "c1", "It rains.", 1)], "query_id int, chunk_id string, text string, final_rank int")
    prompts = answer.prompts(answer.contexts(answer.context_blocks(ranked), asked), asked)
    row = answer.cited(answer.generate(prompts, answer.generator(clients.ChatCompletions("m", server.url)))).first()
    assert (row["answer"], row["model"], row["prompt_tokens"], row["completion_tokens"]) == ("It rains [1].", "m", 3, 4)
    assert row["citations"][0]["chunk_id"] == "c1" and row["latency_ms"] > 0
    assert server.seen[-1][2]["messages"][0]["content"] == answer.SYSTEM_PROMPT and "[1]" in server.seen[-1][3]


def test_claims_keep_or_drop_invalid_citations(spark, server):
    server.say = lambda user, times: json.dumps({"claims": [{"text": " A. ", "citations": [1, 9]}, {"text": "B.", "citations": [9, 8]}]}) if "has" in user else ""
    rows = spark.createDataFrame([(1, "It has [1]."), (2, "nothing"), (3, None)], "query_id int, answer string")
    client = clients.ChatCompletions("m", server.url)
    got = [(r["query_id"], r["text"], r["citations"], r["invalid"]) for r in verify.model_claims(rows, client).orderBy("claim_idx").collect()]
    assert got == [(1, "A.", [1], [9]), (1, "B.", [], [9, 8])]
    kept = verify.model_claims(rows, client, drop_invalid=False)
    assert [r["citations"] for r in kept.orderBy("claim_idx").collect()] == [[1, 9], [9, 8]]
    invalid = {r["query_id"]: r["invalid_references"] for r in verify.invalid_references(kept, rows).collect()}
    assert invalid == {1: [9, 8], 2: [], 3: []}
    with pytest.raises(Exception, match="no claims in the reply"):
        verify.claims_from_replies(spark.createDataFrame([(1, "x", "not json")], "query_id int, answer string, reply string")).collect()


def test_citation_checks(spark, server):
    replies = {"good": '{"verdict": "SUPPORTED", "explanation": " yes "}', "bad": "no json", "odd": '{"verdict": "MAYBE"}'}
    server.say = lambda user, times: next(v for k, v in replies.items() if k in user)
    evidence = spark.createDataFrame([(1, 1, "e")], "query_id int, reference int, text string")
    claims = spark.createDataFrame([(1, 0, "good", [1, 5]), (1, 1, "bad", [1])], "query_id int, claim_idx int, text string, citations array<int>")
    client = clients.ChatCompletions("m", server.url)
    got = {(r["text"], r["reference"]): (r["verdict"], r["explanation"]) for r in verify.model_citation_checks(claims, evidence, client).collect()}
    assert got == {("good", 1): ("SUPPORTED", "yes"), ("good", 5): (None, None), ("bad", 1): ("UNSUPPORTED", verify.INVALID_JSON)}
    assert not any("<claim>\ngood" in x[3] and "<evidence>\ne" not in x[3] for x in server.seen)
    odd = claims.selectExpr("query_id", "claim_idx", "'odd' as text", "citations").limit(1)
    with pytest.raises(Exception, match="unknown verdict"):
        verify.model_citation_checks(odd, evidence, client).collect()


def test_faithfulness_sees_question_and_all_evidence(spark, server):
    server.say = lambda user, times: '{"verdict": "PARTIALLY_SUPPORTED", "explanation": ""}' if "claim one" in user else ""
    blocks = "array<struct<reference:int,text:string>>"
    answers = spark.createDataFrame([(1, "Why?", [(1, "first"), (2, "second")])], f"query_id int, question string, blocks {blocks}")
    claims = spark.createDataFrame([(1, 0, "claim one")], "query_id int, claim_idx int, text string")
    client = clients.ChatCompletions("m", server.url)
    assert verify.model_faithfulness(claims, answers, client).first()["verdict"] == verify.PARTIAL
    assert server.seen[-1][3] == "<question>\nWhy?\n</question>\n<claim>\nclaim one\n</claim>\n<evidence>\n[1]\nfirst\n\n[2]\nsecond\n</evidence>"
    with pytest.raises(Exception, match="no usable reply"):
        verify.model_faithfulness(claims.selectExpr("query_id", "claim_idx", "'two' as text"), answers, client).collect()


def test_judge_asks_up_to_three_times(spark, server):
    whole, cut = '{"verdict": "CORRECT", "explanation": " ok "}', '{"verdict": "INCORRECT", "expl'
    says = {"first": [whole], "third": ["", "?", cut], "never": ["", "", "", whole]}
    server.say = lambda user, times: next(v for k, v in says.items() if k in user)[times - 1]
    cases = spark.createDataFrame([("c", [("s1",), ("s2",)])], "case_id string, evidence_spans array<struct<text:string>>")
    claims = spark.createDataFrame([("c", "first"), ("c", "third")], "case_id string, text string")
    client = clients.ChatCompletions("m", server.url)
    got = {r["text"]: (r["verdict"], r["explanation"]) for r in evaluate.judged_claims(claims, cases, client).collect()}
    assert got == {"first": ("CORRECT", "ok"), "third": ("INCORRECT", "Verdict recovered from truncated structured output.")}
    assert "<reference>\n[1] s1\n[2] s2\n</reference>" in server.seen[0][3]
    with pytest.raises(Exception, match="no usable reply after 3 attempts"):
        evaluate.judged_claims(claims.selectExpr("case_id", "'never' as text").limit(1), cases, client).collect()


def test_semantic_score(spark):
    rows = spark.createDataFrame([("the cat sat", ["dogs bark", "the cat sat here"]), ("the cat sat", []), ("", ["x"])], "f string, u array<string>")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(evaluate.entailment()(F.col("f"), F.col("u"))).collect()]
    assert got[0] > 0.99 and got[1:] == [0.0, 0.0]


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "guide.md").write_text("# Guide\nThe cache is warm.\n## Tokens\nA token expires after seven days. Renew it early.")
    return raw


def test_api(spark, server, tmp_path, folder):
    e = Engine(spark, EngineConfig(store_path=f"file://{tmp_path}/store"))
    api = Api(e)
    status, body = api.ask({"question": "anything"})
    assert status == 500 and body["error"]["code"] == "INTERNAL_ERROR" and body["request_id"]
    assert api.ask({"question": "  "})[0] == 422 and api.ask({})[1]["error"]["code"] == "INVALID_REQUEST"
    e.build_index(f"file://{folder}")
    status, body = api.ask({"question": "When does a token expire?", "include_trace": True})
    assert status == 200 and body["question"] and body["citations"][0]["source"].endswith("guide.md") and json.dumps(body, default=str)
    assert body["trace"]["candidates"][0]["rank"] == 1 and body["trace"]["final_evidence"][0]["final_rank"] == 1
    assert body["verification"]["abstention"]["decision"] in ("ACCEPT", "ACCEPT_WITH_WARNING", "ABSTAIN")
    assert api.ingest("a/b.txt", b"Penguins swim.")[1]["duplicate"] is False
    assert api.ingest("b.txt", b"Penguins swim.")[1]["duplicate"] is True
    assert api.ingest("b.exe", b"x")[0] == 400 and api.ingest("b.txt", b"")[1]["error"]["code"] == "INVALID_FILE"
    assert api.documents()[1]["count"] == 2
    gone = Engine(spark, e.config, client=clients.ChatCompletions("m", "http://127.0.0.1:9"))
    assert Api(gone).ask({"question": "Does a token expire?"})[1]["error"]["code"] == "MODEL_UNAVAILABLE"


def test_engine_with_a_model(spark, server, tmp_path, folder):
    def say(user, times):
        if "<evidence>" in user:
            return '{"verdict": "SUPPORTED", "explanation": "so"}'
        return '{"claims": [{"text": "A token expires.", "citations": [1]}]}' if "<answer>" in user else "A token expires [1]."

    server.say = say
    e = Engine(spark, EngineConfig(store_path=f"file://{tmp_path}/store"), client=clients.ChatCompletions("m", server.url))
    e.build_index(f"file://{folder}")
    row = e.ask(spark.createDataFrame([(1, "When does a token expire?")], "query_id int, text string")).first()
    assert row["final_answer"] == "A token expires [1]." and row["decision"] == "ACCEPT" and row["citation_precision"] == 1.0
    assert row["model"] == "m" and row["prompt_tokens"] == 3


def test_configuration_from_the_environment():
    named = {"LODESTONE_STORE_PATH": "s", "DATA_PATH": "d", "LOG_LEVEL": "DEBUG", "LM_STUDIO_BASE_URL": "u", "LM_STUDIO_MODEL": "m"}
    got = EngineConfig.from_env(environ=named)
    assert (got.store_path, got.data_path, got.log_level, got.client()) == ("s", "d", "DEBUG", clients.ChatCompletions("m", "u"))
    assert EngineConfig.from_env("own", {}).store_path == "own" and EngineConfig.from_env("own", {}).client() is None
    with pytest.raises(EngineError):
        EngineConfig.from_env(environ={})
