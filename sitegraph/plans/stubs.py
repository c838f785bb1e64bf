"""A deterministic stand-in for the model, used by the registered queries and
tests (no network): it describes the prompt by its length and fails when the
prompt holds no URL, so both the success and the error text paths run."""

from __future__ import annotations

EMPTY_MARK = "website:\n                \n"


def echo_model(prompt: str) -> str:
    if EMPTY_MARK in prompt:
        raise ValueError("no URLs to analyse")
    return f"- Company Overview: {len(prompt)} characters"
