"""Tip triage as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pressline.operators.submissions import accepted_tips, captcha_gate, triage


def judge_tips(submissions: DataFrame) -> DataFrame:
    """Every submission with its final status and reason."""
    return captcha_gate(triage(submissions))


def tips(submissions: DataFrame) -> DataFrame:
    return accepted_tips(judge_tips(submissions))
