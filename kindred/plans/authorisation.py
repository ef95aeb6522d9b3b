"""Runs that happen once: a request commits to a plan, an authorisation to the request, and a claim bars a second run."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from kindred.operators.ledger import canonical_json, sha256_text, write_json


class NotAuthorised(RuntimeError):
    """Request, authorisation and plan do not fit together."""


def _sealed(record: dict) -> dict:
    return record | {"sha256": sha256_text(canonical_json(record))}


def _intact(record: dict) -> bool:
    return record.get("sha256") == sha256_text(canonical_json({k: v for k, v in record.items() if k != "sha256"}))


def request(plan: dict, reason: str) -> dict:
    if not reason.strip():
        raise ValueError("a request needs a reason")
    return _sealed({"kind": "request", "plan_sha256": sha256_text(canonical_json(plan)), "reason": reason.strip()})


def authorise(asked: dict, by: str, decision: str) -> dict:
    """decision: AUTHORISED or REFUSED."""
    if asked.get("kind") != "request" or not _intact(asked):
        raise NotAuthorised("the request was changed")
    if decision not in ("AUTHORISED", "REFUSED") or not by.strip():
        raise ValueError("a decision needs its author and must be AUTHORISED or REFUSED")
    return _sealed({"kind": "authorisation", "request_sha256": asked["sha256"], "by": by.strip(), "decision": decision})


def execute_once(folder: str | Path, plan: dict, asked: dict, granted: dict, work: Callable[[dict], dict]) -> dict:
    """Run ``work(plan)`` and keep its receipt; claim, receipt and failure are files that are never replaced.

    Raises before any work if something was changed or refused, or if the request was claimed before, whether or not
    that run succeeded. A failing run leaves ``failure.json`` and raises.
    """
    folder = Path(folder)
    if not (_intact(asked) and _intact(granted)):
        raise NotAuthorised("a record was changed")
    if granted.get("kind") != "authorisation" or granted["request_sha256"] != asked["sha256"] or asked["plan_sha256"] != sha256_text(canonical_json(plan)):
        raise NotAuthorised("the authorisation is for something else")
    if granted["decision"] != "AUTHORISED":
        raise NotAuthorised("refused")
    write_json(folder / "claim.json", _sealed({"kind": "claim", "authorisation_sha256": granted["sha256"]}))
    try:
        output = work(plan)
    except Exception as e:
        write_json(folder / "failure.json", _sealed({"kind": "failure", "authorisation_sha256": granted["sha256"], "error": type(e).__name__}))
        raise
    receipt = _sealed({"kind": "receipt", "authorisation_sha256": granted["sha256"], "output_sha256": sha256_text(canonical_json(output))})
    write_json(folder / "receipt.json", receipt)
    return receipt


def publish(folder: str | Path, receipt: dict, output: dict, reviewed_by: str) -> dict:
    """Write a reviewed output and its record; the output must be the receipt's."""
    if receipt.get("kind") != "receipt" or not _intact(receipt) or receipt["output_sha256"] != sha256_text(canonical_json(output)):
        raise NotAuthorised("the output is not that of the receipt")
    if not reviewed_by.strip():
        raise ValueError("a publication needs its reviewer")
    record = _sealed({"kind": "publication", "receipt_sha256": sha256_text(canonical_json(receipt)), "output_sha256": receipt["output_sha256"], "reviewed_by": reviewed_by.strip()})
    write_json(Path(folder) / "output.json", output)
    write_json(Path(folder) / "publication.json", record)
    return record
