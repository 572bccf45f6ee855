"""From contract documents to verdicts: documents are compiled to operations, calls are bound, routed, judged, and held against what is deprecated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirewarden.operators.routing import route
from wirewarden.operators.validation import bind, judge_responses, used_deprecations
from wirewarden.sources.contracts import openapi_operations

#: What a routed call carries of its operation.
CARRIED = ("responses", "deprecated", "sunset", "parameters", "fields", "response_fields")


def contract_operations(contracts: DataFrame) -> DataFrame:
    """The operations of all OpenAPI contracts (integration, format, doc), by `contract`, the integration; a document that cannot be read has a row with its error.
    It is used several times by what follows: persist it, it is as small as the documents."""
    return openapi_operations(contracts.filter("format = 'openapi'").select(F.col("integration").alias("contract"), "doc"))


def judge_by_documents(calls: DataFrame, contracts: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """JN1 to JN3, VAL1 to VAL5, VAL7: calls with contract, template, reason, verdict, violations, media_finding and what the operation carries.

    calls: id, peer_host, direction, method, route (the path, with the servers' base path), status, content_type, headers, body. contracts: integration, role,
    format, peer_host, doc. operations: those of `contract_operations`, by default made here. A call that is bound to a document that cannot be read has the reason
    validator-error.
    """
    operations = contract_operations(contracts) if operations is None else operations
    bound = bind(calls.drop("contract"), contracts)
    broken = operations.filter("error is not null").select(F.col("contract").alias("_contract")).distinct().withColumn("_broken", F.lit(True))
    routed = route(bound, operations.filter("error is null"), by="contract", carry=CARRIED)
    judged = judge_responses(routed).join(broken, F.col("contract") == F.col("_contract"), "left")
    return judged.withColumn("reason", F.when(F.col("_broken"), "validator-error").otherwise(F.col("reason"))).drop("_contract", "_broken")


def deprecations(judged: DataFrame) -> DataFrame:
    """VAL11 for calls of `judge_by_documents` that also have url, request_headers and request_body: see `used_deprecations`."""
    return used_deprecations(judged.filter("template is not null"))
