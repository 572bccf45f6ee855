"""OpenAPI 3 documents (JSON, or YAML where a parser is installed) compiled to operations: each distinct document once a job.

An operation's row has what calls are judged by (media types and schemas by status, required headers, parameters by place, deprecated fields, base
paths) and what versions are compared by (one input and one output schema). Schemas to judge by keep their references, cycles too: a schema's text brings what
it refers to. Schemas to compare have references inlined, where a cycle is opaque. No keyword is left out of either.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
#: Keywords whose value is a schema, a list of schemas, or schemas by name.
ONE = ("additionalItems", "additionalProperties", "contains", "else", "if", "items", "not", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties")
LIST = ("allOf", "anyOf", "oneOf", "prefixItems")
NAMED = ("dependentSchemas", "patternProperties", "properties")
#: Columns of a compiled operation.
COLUMNS = {
    "method": "string", "template": "string", "op": "string", "description": "string", "input_schema": "string", "output_schema": "string", "deprecated": "boolean", "sunset": "string",
    "parameters": "array<struct<name:string,place:string,required:boolean,deprecated:boolean,schema:string>>", "deprecated_parameters": "array<string>", "request": "map<string,string>",
    "responses": "map<string,struct<content:map<string,string>,required_headers:array<string>>>", "fields": "array<string>", "response_fields": "map<string,array<string>>", "base_paths": "array<string>",
    "title": "string", "version": "string", "path_count": "int", "docs_url": "string", "server_hosts": "array<string>", "error": "string",
}
NAMES = list(COLUMNS)
OPERATION = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())


def parse(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        if yaml is None:
            raise
        return yaml.safe_load(text)


def follow(ref, document):
    """What a reference inside the document names, or None."""
    if not isinstance(ref, str) or not ref.startswith("#/"):
        return None
    node = document
    for step in ref[2:].split("/"):
        step = step.replace("~1", "/").replace("~0", "~")
        node = node.get(step) if isinstance(node, dict) else None
    return node


def resolve(node, document: dict):
    """A node with its references followed; what they lead to, or {}."""
    seen: set[str] = set()
    while isinstance(node, dict) and "$ref" in node:
        if str(node["$ref"]) in seen:
            return {}
        seen.add(str(node["$ref"]))
        node = follow(node["$ref"], document)
    return {} if node is None else node


def plain_schema(node, document: dict, above: tuple[str, ...] = ()):
    """A schema with references inlined (a cycle is opaque: {}; a schema too deep for the interpreter makes an error row) and `nullable` as a null type."""
    if isinstance(node, bool):
        return node
    ref = node.get("$ref") if isinstance(node, dict) else None
    if ref is not None and ref in above:
        return {}
    node = resolve(node, document)
    if not isinstance(node, dict):
        return node if isinstance(node, bool) else {}
    inner = above if ref is None else (*above, ref)
    out = {k: v for k, v in node.items() if k not in ("nullable", *ONE, *LIST, *NAMED)}
    if node.get("nullable") and "type" in out:
        out["type"] = sorted({*([out["type"]] if isinstance(out["type"], str) else out["type"]), "null"})
    for key in ONE:
        if isinstance(node.get(key), list):
            out[key] = [plain_schema(own, document, inner) for own in node[key]]
        elif key in node:
            out[key] = plain_schema(node[key], document, inner)
    for key in LIST:
        if isinstance(node.get(key), list):
            out[key] = [plain_schema(own, document, inner) for own in node[key]]
    for key in NAMED:
        if isinstance(node.get(key), dict):
            out[key] = {name: plain_schema(own, document, inner) for name, own in node[key].items()}
    return out


def _references(node) -> Iterator[str]:
    ahead = [node]
    while ahead:
        node = ahead.pop()
        if isinstance(node, dict):
            if isinstance(node.get("$ref"), str):
                yield node["$ref"]
            ahead += node.values()
        elif isinstance(node, list):
            ahead += node


def schema_text(node, document: dict) -> str:
    """A schema as text that stands alone: everything it refers to, at the place where the document has it."""
    needed: dict[str, object] = {}
    ahead = list(_references(node))
    while ahead:
        ref = ahead.pop()
        if ref not in needed and (found := follow(ref, document)) is not None:
            needed[ref] = found
            ahead += _references(found)
    if not needed:
        return json.dumps(node, sort_keys=True, ensure_ascii=False)
    out: dict = {"$ref": "#/$root", "$root": node}
    for ref in sorted(needed, key=len):  # what holds another place comes before it
        steps = [s.replace("~1", "/").replace("~0", "~") for s in ref[2:].split("/")]
        at = out
        for step in steps[:-1]:
            at = at.setdefault(step, {})
        at.setdefault(steps[-1], needed[ref])
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def deprecated_fields(node, document: dict, path: str = "", above: tuple[int, ...] = ()) -> set[str]:
    """Paths (dotted, [] for elements) of the deprecated properties of a schema, whatever alternatives lead there; a cycle is not followed again."""
    node = resolve(node, document)
    if not isinstance(node, dict) or id(node) in above:
        return set()
    inner = (*above, id(node))
    found: set[str] = set()
    for key in ("allOf", "anyOf", "oneOf"):
        for own in node[key] if isinstance(node.get(key), list) else []:
            found |= deprecated_fields(own, document, path, inner)
    for name, own in node["properties"].items() if isinstance(node.get("properties"), dict) else []:
        at = f"{path}.{name}" if path else name
        target = resolve(own, document)
        if isinstance(target, dict) and target.get("deprecated") is True:
            found.add(at)
        found |= deprecated_fields(own, document, at, inner)
    if isinstance(node.get("items"), dict):
        found |= deprecated_fields(node["items"], document, f"{path}[]", inner)
    return found


def _content(node, document: dict) -> dict:
    """Media types with their schema nodes (None: none)."""
    content = resolve(node, document).get("content")
    return {str(kind): own.get("schema") if isinstance(own, dict) else None for kind, own in content.items()} if isinstance(content, dict) else {}


def _is_json(kind: str) -> bool:
    bare = kind.split(";")[0].strip().lower()
    return bare == "application/json" or bare.endswith("+json")


def _json_schema(content: dict, document: dict):
    kind = next((k for k in sorted(content) if _is_json(k)), None)
    return None if kind is None or content[kind] is None else plain_schema(content[kind], document)


def _texts(content: dict, document: dict) -> dict[str, str]:
    return {kind: "" if node is None else schema_text(node, document) for kind, node in content.items()}


def _servers(node) -> list[str]:
    """URLs of a list of servers, variables at their defaults."""
    out = []
    for server in node if isinstance(node, list) else []:
        if isinstance(server, dict) and isinstance(server.get("url"), str):
            own = server["variables"] if isinstance(server.get("variables"), dict) else {}
            out.append(re.sub(r"\{([^}]*)\}", lambda m, own=own: str(own[m[1]]["default"]) if isinstance(own.get(m[1]), dict) and "default" in own[m[1]] else m[0], server["url"]))
    return out


def _base_path(url: str) -> str:
    rest = url.split("://", 1)[1].partition("/")[2] if "://" in url else url
    bare = re.split("[?#]", rest)[0].strip("/")
    return f"/{bare}" if bare else ""


def server_host(url: str) -> str | None:
    """The plain host of a server's URL; none where it is relative or a template."""
    text = url.strip()
    if not text or text.startswith("/"):
        return None
    host = re.split("[/?#]", text.split("://", 1)[-1])[0].rpartition("@")[2].partition(":")[0].strip().lower()
    return host if host and not re.search("[{} ]", host) else None


def summary(document: dict) -> dict:
    """What a document says of itself: title, version, number of paths, address of its documentation, hosts of its servers in their order."""
    info, docs, paths = (document.get(k) if isinstance(document.get(k), dict) else {} for k in ("info", "externalDocs", "paths"))
    hosts = [h for s in document.get("servers") or [] if isinstance(s, dict) and (h := server_host(str(s.get("url", ""))))]
    text = lambda v: None if v is None else str(v)
    return {"title": text(info.get("title")), "version": text(info.get("version")), "path_count": len(paths), "docs_url": text(docs.get("url")), "server_hosts": list(dict.fromkeys(hosts))}


def operations(document: dict) -> Iterator[dict]:
    """The operations of a document, by path and method.

    DIF3: path and query parameters (the operation's before the path's) and the members of an object body are one input object, any
    other body is its member `body`; the output is the JSON schema of the lowest 2xx response.
    """
    told = summary(document)
    dump = lambda s: None if s is None else json.dumps(s, sort_keys=True, ensure_ascii=False)
    for template, item in sorted((document.get("paths") or {}).items()):
        item = resolve(item, document)
        for method in METHODS:
            if not isinstance(own := item.get(method), dict):
                continue
            servers = next((s for s in (own.get("servers"), item.get("servers"), document.get("servers")) if s), [])
            parameters: dict = {}
            for p in [*(item.get("parameters") or []), *(own.get("parameters") or [])]:
                p = resolve(p, document)
                parameters[p.get("name"), p.get("in")] = p
            given = {name: p for (name, place), p in parameters.items() if place in ("path", "query")}
            properties = {name: plain_schema(p.get("schema") or {}, document) for name, p in given.items()}
            required = {name for name, p in given.items() if p.get("required") or p.get("in") == "path"}
            body = resolve(own.get("requestBody") or {}, document)
            sent = _content(body, document)
            schema = _json_schema(sent, document)
            if isinstance(schema, dict) and schema.get("type") == "object":
                properties |= schema.get("properties") or {}
                required |= set(schema.get("required") or [])
            elif schema is not None:
                properties["body"] = schema
                required |= {"body"} if body.get("required") else set()
            answers = {str(status): resolve(node, document) for status, node in (own.get("responses") or {}).items() if not str(status).startswith("x-")}
            answers = {"default" if status == "default" else status.upper(): node for status, node in answers.items() if isinstance(node, dict)}
            good = min((status for status in answers if status.startswith("2")), default=None)
            content = {status: _content(node, document) for status, node in answers.items()}
            headers = {status: sorted(name.lower() for name, h in (node.get("headers") or {}).items() if resolve(h, document).get("required") is True and name.lower() != "content-type") for status, node in answers.items()}
            fields = lambda nodes: sorted(set().union(*[deprecated_fields(n, document) for n in nodes if n is not None]))
            yield told | {
                "method": method.upper(), "template": template, "op": own.get("operationId") or f"{method.upper()} {template}", "description": own.get("description") or own.get("summary") or "",
                "input_schema": dump({"type": "object", "properties": properties, "required": sorted(required)}), "output_schema": dump(_json_schema(content[good], document)) if good else None,
                "deprecated": own.get("deprecated") is True, "sunset": None if own.get("x-sunset") is None else str(own["x-sunset"]),
                "parameters": [{"name": name, "place": place, "required": bool(p.get("required")), "deprecated": p.get("deprecated") is True, "schema": None if p.get("schema") is None else schema_text(p["schema"], document)}
                               for (name, place), p in sorted(parameters.items(), key=lambda x: (str(x[0][0]), str(x[0][1])))],
                "deprecated_parameters": sorted(name for (name, place), p in parameters.items() if p.get("deprecated") is True and place == "query"),
                "request": _texts(sent, document), "responses": {status: {"content": _texts(own_content, document), "required_headers": headers[status]} for status, own_content in content.items()},
                "fields": fields(sent.values()), "response_fields": {status: found for status, own_content in content.items() if (found := fields(own_content.values()))},
                "base_paths": sorted({_base_path(url) for url in _servers(servers)}), "error": None,
            }


def openapi_operations(documents: DataFrame, column: str = "doc") -> DataFrame:
    """SRC6: a row for each operation of each document, beside the document's other columns; a document that cannot be read has one row that
    says why, one without operations and a null one have none. A text that several rows have is compiled once; columns named like those of an operation are replaced."""
    rest = [c for c in documents.columns if c != column and c not in NAMES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, text in zip(batch["_digest"], batch["_text"], strict=True):
                try:
                    found = list(operations(parse(text)))
                except Exception as e:  # any document may come
                    found = [dict.fromkeys(NAMES) | {"error": f"{type(e).__name__}: {e}"[:200]}]
                rows += [{"_digest": digest} | own for own in found]
            yield pd.DataFrame(rows, columns=["_digest", *NAMES])

    named = documents.withColumn("_digest", F.sha2(F.col(column), 256))
    texts = named.filter("_digest is not null").groupBy("_digest").agg(F.first(column).alias("_text"))
    compiled = texts.mapInPandas(run, f"_digest string, {OPERATION}")
    return named.select("_digest", *rest).join(compiled, "_digest").select(*rest, *NAMES)


def document_summaries(documents: DataFrame, column: str = "doc") -> DataFrame:
    """SRC6: the documents' other columns with title, version, path_count, docs_url, server_hosts and error, a row for each document."""
    fields = ("title", "version", "path_count", "docs_url", "server_hosts", "error")
    schema = "title string, version string, path_count int, docs_url string, server_hosts array<string>, error string"

    @F.pandas_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    def told(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return summary(parse(text)) | {"error": None}
            except Exception as e:  # any document may come
                return dict.fromkeys(fields) | {"error": f"{type(e).__name__}: {e}"[:200]}

        known = {text: one(text) for text in texts.dropna().unique()}
        rows = [known.get(t, dict.fromkeys(fields)) for t in texts]
        return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in fields}).astype({"path_count": "Int32"})

    rest = [c for c in documents.columns if c != column and c not in fields]
    return documents.select(*rest, told(column).alias("_told")).select(*rest, "_told.*")
