"""Routing, similarity and narration as functions written in SQL, which the optimiser inlines into the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import routing as R


def _list(names: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in names)


def _ends(names: list[str]) -> str:
    return " OR ".join(f"endswith(low, '{x}')" for x in names)


def _extension(path: str) -> str:
    return f"lower(substring_index({path}, '.', -1))"


def _tokens(text: str) -> str:
    return rf"array_distinct(filter(split(lower({text}), r'\W+'), x -> x <> ''))"


def _human(kind: str) -> str:
    return f"lower(replace(regexp_replace({kind}, '([a-z])([A-Z])', '$1 $2'), '_', ' '))"


def _flat(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, r'(?U)\s+', ' '), '^ | $', '')"


def _short(flat: str, most: int | str) -> str:
    return f"CASE WHEN {flat} = '' THEN NULL WHEN length({flat}) > {most} THEN concat(substring({flat}, 1, {most} - 1), '…') ELSE {flat} END"


_PAIR = "STRUCT<kind: STRING, label: STRING>"
#: name, parameters, type, body.  Bodies don't call one another: a function called inside a subquery isn't inlined.
FUNCTIONS = (
    ("file_extension", "path STRING", "STRING", _extension("path")),
    (
        "classify",
        "path STRING",
        "TINYINT",
        f"""(SELECT CAST(CASE WHEN low IS NULL THEN NULL WHEN ext IN ({_list(R.BINARY_EXTENSIONS)}) THEN {R.BINARY}
          WHEN ext IN ({_list([*R.DATA_EXTENSIONS, "env"])}) THEN {R.DATA} WHEN ext IN ({_list(R.MARKUP_EXTENSIONS)}) THEN {R.MARKUP}
          WHEN ext IN ({_list(R.RAW_EXTENSIONS)}) THEN {R.RAW} WHEN ext IN ({_list(R.PROSE_EXTENSIONS)}) THEN {R.PROSE}
          WHEN ext IN ({_list(R.CODE_EXTENSIONS)}) THEN IF({_ends(R.PROSE_NAMES)}, {R.PROSE}, {R.CODE})
          WHEN {_ends([".env", ".env.local"])} THEN {R.DATA} WHEN {_ends(R.PROSE_NAMES)} THEN {R.PROSE} ELSE {R.RAW} END AS TINYINT)
          FROM (SELECT lower(path) AS low, {_extension("path")} AS ext))""",
    ),
    ("name_tokens", "text STRING", "ARRAY<STRING>", _tokens("text")),
    (
        "jaccard_tokens",
        "a STRING, b STRING",
        "DOUBLE",
        # Lambdas bind the tokens and what is common, so that neither text is taken apart again where they are used.
        f"""get(transform(array(struct({_tokens("coalesce(a, '')")} AS x, {_tokens("coalesce(b, '')")} AS y)),
          p -> get(transform(array(size(array_intersect(p.x, p.y))), n -> IF(size(p.x) + size(p.y) > 0, n / (size(p.x) + size(p.y) - n), 0D)), 0)), 0)""",
    ),
    ("humanize_kind", "kind STRING", "STRING", _human("kind")),
    (
        "glimpse",
        "text STRING, most INT",
        "STRING",
        f"(SELECT {_short('flat', 'most')} FROM (SELECT {_flat('text')} AS flat))",
    ),
    (
        "narrate_action",
        f"action STRING, kind STRING, label STRING, value STRING, detail STRUCT<kind: STRING, `from`: STRING, `to`: STRING>, from_parent {_PAIR}, to_parent {_PAIR}, to_position INT, context ARRAY<{_PAIR}>",
        "STRING",
        f"""(SELECT CASE action
            WHEN 'Insert' THEN concat('added ', what, coalesce(concat(' in ', scope), ''))
            WHEN 'Delete' THEN concat('removed ', what, coalesce(concat(' from ', scope), ''))
            WHEN 'Move' THEN IF(coalesce(from_parent.label, '') <> '' AND coalesce(to_parent.label, '') <> '', concat('moved ', what, ' from ', from_parent.label, ' to ', to_parent.label),
              concat('moved ', what, ' to position ', to_position + 1, coalesce(concat(' in ', scope), '')))
            ELSE concat(CASE WHEN detail.kind = 'Renamed' THEN concat('renamed ', bare, ' `', coalesce(detail.`from`, ''), '` to `', coalesce(detail.`to`, ''), '`')
              WHEN detail.`from` IS NOT NULL AND detail.`to` IS NOT NULL THEN concat('changed ', target, ' from `', coalesce({_short("was", 40)}, ''), '` to `', coalesce({_short("now", 40)}, ''), '`')
              WHEN detail.`from` IS NOT NULL THEN concat('removed ', target)
              WHEN detail.`to` IS NOT NULL THEN concat('set ', target, ' to `', coalesce({_short("now", 40)}, ''), '`')
              ELSE concat('modified ', what) END, coalesce(concat(' in ', scope), '')) END
          FROM (SELECT bare, was, now, IF(coalesce(shown, '') <> '', concat(bare, ' `', shown, '`'), bare) AS what,
              IF(coalesce(label, '') <> '', concat('value of ', bare, ' `', label, '`'), bare) AS target, concat({_human("near.kind")}, ' `', near.label, '`') AS scope
            FROM (SELECT bare, was, now, near, coalesce(label, {_short("flat", 40)}) AS shown
              FROM (SELECT {_human("kind")} AS bare, {_flat("value")} AS flat, {_flat("detail.`from`")} AS was, {_flat("detail.`to`")} AS now,
                try_element_at(filter(context, c -> coalesce(c.label, '') <> '' AND c.label <> 'unnamed'), 1) AS near))))""",
    ),
)


def register_sql_functions(spark: SparkSession) -> None:
    """Make file_extension, classify, name_tokens, jaccard_tokens, humanize_kind, glimpse and narrate_action known to the session's SQL."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
