"""Requests and answers of a service over the engine, without a web framework.

Every call gives a status and a body that can go out as JSON. Failures have the
body {"request_id": ..., "error": {"code": ..., "message": ...}}.
"""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from lodestone.clients import ModelUnavailable
from lodestone.plans.engine import Engine
from lodestone.sources.files import SourceError

VERDICTS = ("supported", "partially_supported", "unsupported", "contradicted")


def failure(request_id: str, status: int, code: str, message: str) -> tuple[int, dict]:
    return status, {"request_id": request_id, "error": {"code": code, "message": message}}


def unavailable(error: BaseException) -> bool:
    """Whether a model could not be reached, also where an executor says so."""
    return isinstance(error, ModelUnavailable) or ModelUnavailable.__name__ in str(error)


@dataclass
class Api:
    engine: Engine

    def ask(self, body: dict) -> tuple[int, dict]:
        """Answer body["question"]; with body["include_trace"], candidates and evidence too.

        422 for a blank question, 503 if a model can't be reached, 500 for anything else.
        """
        request_id, log = str(uuid.uuid4()), logging.getLogger("lodestone.api")
        question = body.get("question")
        if not isinstance(question, str) or not question.strip():
            return failure(request_id, 422, "INVALID_REQUEST", "The question must not be blank.")
        start = time.perf_counter()
        try:
            asked = self.engine.spark.createDataFrame([(1, question)], "query_id long, text string")
            row = self.engine.ask(asked).first().asDict(True)
            out = self._answered(request_id, question, row)
            if body.get("include_trace"):
                out["trace"] = {
                    "candidates": [r.asDict(True) for r in self.engine.trace(asked).orderBy("rank").collect()],
                    "final_evidence": [r.asDict(True) for r in self.engine.evidence(asked).orderBy("final_rank").collect()],
                }
        except Exception as e:
            log.exception("request_failed", extra={"fields": {"request_id": request_id, "exception_type": type(e).__name__}})
            if unavailable(e):
                return failure(request_id, 503, "MODEL_UNAVAILABLE", "The language model cannot be reached.")
            return failure(request_id, 500, "INTERNAL_ERROR", "The request could not be completed.")
        out["latency"] = {"generation_ms": row["latency_ms"], "total_ms": 1000 * (time.perf_counter() - start)}
        log.info("request_completed", extra={"fields": {"request_id": request_id, "abstained": out["abstained"]} | out["latency"]})
        return 200, out

    def _answered(self, request_id: str, question: str, row: dict) -> dict:
        blocks = {b["reference"]: b for b in row["blocks"]}
        named = ("chunk_id", "source", "page_number", "heading_path")
        tokens = [row["prompt_tokens"], row["completion_tokens"]]
        return {
            "request_id": request_id,
            "question": question,
            "answer": row["final_answer"],
            "abstained": row["should_abstain"],
            "citations": [{"reference": c["reference"]} | {n: blocks[c["reference"]][n] for n in named} for c in row["citations"]],
            "verification": {
                "citation_metrics": {n: row[n] for n in ("citation_precision", "citation_coverage", "total_verifications", *VERDICTS)},
                "faithfulness": {"total_claims": row["total_claims"]} | {f"{v}_claims": row[f"{v}_claims"] for v in VERDICTS},
                "abstention": {n: row[n] for n in ("should_abstain", "decision", "reasons")},
            },
            "token_usage": {
                "input_tokens": tokens[0],
                "output_tokens": tokens[1],
                "total_tokens": sum(tokens) if None not in tokens else None,
            },
            "trace": None,
        }

    def ingest(self, filename: str, content: bytes) -> tuple[int, dict]:
        """Add one file: its registry row and whether it was known. 400 for a file that can't be taken, 500 for anything else."""
        request_id = str(uuid.uuid4())
        try:
            rows = self.engine.spark.createDataFrame([(filename, bytearray(content))], "filename string, content binary")
            return 200, self.engine.ingest(rows).first().asDict(True)
        except SourceError as e:
            return failure(request_id, 400, "INVALID_FILE", str(e))
        except Exception as e:
            logging.getLogger("lodestone.api").exception("ingest_failed", extra={"fields": {"exception_type": type(e).__name__}})
            return failure(request_id, 500, "INTERNAL_ERROR", "The file could not be added.")

    def documents(self, after: tuple[str, str] | None = None, limit: int = 1000) -> tuple[int, dict]:
        """Registered documents by name, at most `limit` of them, and the number of all.

        after: the filename and document_id of the last one of the page before; `next` has them if there are more.
        """
        listed = self.engine.list_documents()
        place = F.struct("filename", "document_id")
        page = listed if after is None else listed.where(place > F.struct(F.lit(after[0]).alias("filename"), F.lit(after[1]).alias("document_id")))
        rows = [r.asDict(True) for r in page.orderBy("filename", "document_id").limit(limit + 1).collect()]
        more = {"next": [rows[limit - 1]["filename"], rows[limit - 1]["document_id"]]} if len(rows) > limit else {}
        return 200, {"documents": rows[:limit], "count": listed.count()} | more
