"""Context renderers: lines of text about ranked capsules, chosen by task type, under a budget.

`top` is a few ranked capsules (column `place` from 1); `every` is the whole table. Each renderer is a plan that ends
in rows (part, place, line) and one ordered concatenation; what goes into it is bounded by the renderer's own limits.
Of the whole table only the rows that a rule picks (callers, callees, tests, undocumented ones) are looked at.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.tasks import mentioned_framework
from lodeseek.functions.text import clip
from lodeseek.schema import PROPERTIES, prop

#: Property names never shown, and root fields shown after the properties (in alphabetical order).
SKIPPED = ["id", "status", "created_at", "updated_at", "source_doc_id", "source_hash", "aliases", "_depth", "precision_critical", "embedding"]
NODE_FIELDS = [
    "aplica_a", "categoria", "confidence", "descripcion", "description", "descuento", "descuento_pct", "docstring", "edad_maxima", "edad_minima",
    "hereda_de", "importado_por", "lineas", "lineas_aprox", "metodos", "metodos_publicos", "module", "parametros", "path", "penalizacion",
    "penalizacion_max", "permanencia", "porcentaje", "precio", "precio_base", "precio_final", "requisitos", "restricciones", "segmento",
    "servicios", "tipo_condicion", "tipo_retorno", "valor", "valor_maximo",
]
ADVICE = {
    "code_edit": "\n\nUsa read_file para ver el contenido completo antes de modificar.",
    "debug": "\n\nDepura la funcion target. Revisa callers y callees. Usa read_file si necesitas mas contexto.",
    "test_gen": "\n\nGenera tests para la funcion target. Usa los tests existentes como referencia de estilo.",
    "review": "\n\nRevisa este codigo. Busca bugs, problemas de estilo, seguridad, y mejoras.",
    "optimize": "\n\nOptimiza este codigo. Busca: bucles innecesarios, I/O bloqueante, copias de datos, complejidad algoritmica alta.",
    "audit": "\n\nAudita este codigo por seguridad. Busca: SQL injection, XSS, path traversal, hardcoded secrets, input validation, auth bypass.",
    "design_review": "\n\nAnaliza el diseño, copy, colores, accesibilidad, jerarquía visual y UX.",
}
CUT_MARK = "\n# ... [truncado]"
# End of the fixed values.


def pairs(**items: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v.cast("string"), F.lit("")).alias("v")) for k, v in items.items()])


def node_line(name: Column, kind: Column, properties: Column) -> Column:
    """`[name|type] k=v, ...`: empty and skipped properties left out, new lines as blanks, values clipped."""
    kept = F.filter(properties, lambda p: (p.v != "") & (p.v != "0") & p.v.isNotNull() & ~p.k.isin(SKIPPED))
    shown = F.array_join(F.transform(kept, lambda p: F.concat(p.k, F.lit("="), clip(F.trim(F.replace(p.v, F.lit("\n"), F.lit(" ")))))), ", ")
    return F.concat(F.lit("["), name, F.lit("|"), kind, F.lit("]"), F.when(shown != "", F.concat(F.lit(" "), shown)).otherwise(""))


def _named(name: str):
    return lambda p: p.k == F.lit(name)


def serialize_nodes(nodes: DataFrame) -> DataFrame:
    """(id, line) of nodes (id, name, type, properties); root columns of NODE_FIELDS follow where the properties lack them."""
    root = [c for c in NODE_FIELDS if c in nodes.columns]
    extra = [F.when(~F.exists("properties", _named(c)), F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))) for c in root]
    props = F.concat(F.col("properties"), F.filter(F.array(*extra), lambda x: x.isNotNull())) if extra else F.col("properties")
    return nodes.select("id", node_line(F.coalesce("name", F.col("id").cast("string")), F.coalesce("type", F.lit("")), props.cast(PROPERTIES)).alias("line"))


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with a column line, `[a]-[REL]-[b]`; an endpoint that is no node shows the first 12 characters of its id."""
    label = nodes.select(F.col("id").cast("string").alias("id"), F.coalesce("name", F.col("id").cast("string")).alias("name"))
    out = edges.join(label.select(F.col("id").alias("src"), F.col("name").alias("_a")), "src", "left").join(label.select(F.col("id").alias("dst"), F.col("name").alias("_b")), "dst", "left")
    shown = lambda n, i: F.coalesce(F.col(n), F.substring(i, 1, 12))
    return out.withColumn("line", F.concat(F.lit("["), shown("_a", "src"), F.lit("]-["), "type", F.lit("]-["), shown("_b", "dst"), F.lit("]"))).drop("_a", "_b")


def joined(rows: DataFrame, order: list[str], line: str = "line", tail: str = "") -> DataFrame:
    """One row `context`: lines in order, then a tail unless there are none."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda r: r[line]), "\n")
    return rows.agg(text.alias("context")).select(F.when(F.col("context") != "", F.concat("context", F.lit(tail))).otherwise("").alias("context"))


def first_per_name(top: DataFrame) -> DataFrame:
    return top.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("place"))).where("_n = 1").drop("_n")


def budget_prefix(rows: DataFrame, cost: Column, budget: int | Column) -> DataFrame:
    """Rows in order of place while their running cost stays within the budget; rows are a ranked list, thus few."""
    run = F.sum(cost).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def _doc() -> Column:
    return F.coalesce("docstring", F.lit(""))


def _listed(name: str, n: int) -> Column:
    return F.array_join(F.slice(name, 1, n), ", ")


def _line(**props: Column) -> Column:
    return node_line(F.col("name"), F.col("type"), pairs(**props))


def _facts() -> dict[str, Column]:
    return {"signature": F.col("signature"), "file_path": F.col("file_path"), "docstring": _doc()}


def _lines() -> Column:
    return F.coalesce(prop("lineas"), (F.col("end_line") - F.col("start_line") + 1).cast("string"))


def query(top: DataFrame, budget: int) -> DataFrame:
    """The first capsule with its body if that fits, the others by signature while the budget lasts; then five calls."""
    chars = budget * 4
    rows = first_per_name(top)
    fence = F.when(F.col("type") == "document", F.concat(F.lit("|doc] "), "file_path", F.lit("\n"), "content")).when(F.col("type") == "file_header", F.concat(F.lit("|file_header] "), "file_path", F.lit("\n```python\n"), "content", F.lit("\n```"))).otherwise(
        F.concat(F.lit("|"), "type", F.lit("] "), "file_path", F.lit("\n```\n"), "content", F.lit("\n```"))
    )
    body = F.concat(F.lit("["), "name", fence)
    whole = (F.col("place") == 1) & (F.coalesce("content", F.lit("")) != "") & F.col("type").isin("function", "class", "document", "file_header") & (F.length(body) <= chars)
    brief = F.length("name") + F.length(F.coalesce("signature", F.lit(""))) + F.length(_doc())
    rows = rows.withColumn("whole", whole).withColumn("cost", F.when(F.col("whole"), F.length(body)).otherwise(brief))
    rows = budget_prefix(rows, F.col("cost"), chars)
    short = _line(**_facts(), calls=_listed("calls", 8), imports=_listed("imports", 8), parametros=prop("parametros"), tipo_retorno=prop("tipo_retorno"))
    lines = rows.select(F.lit(0).alias("part"), "place", F.lit(0).alias("pos"), F.when(F.col("whole"), body).otherwise(short).alias("line"))
    calls = top.select("place", "name", F.posexplode(F.slice("calls", 1, 5)).alias("pos", "call")).orderBy("place", "pos").limit(5)
    calls = calls.select(F.lit(2).alias("part"), "place", "pos", F.concat(F.lit("["), "name", F.lit("]-[LLAMA]-["), "call", F.lit("]")).alias("line"))
    rule = calls.limit(1).select(F.lit(1).alias("part"), F.lit(0).alias("place"), F.lit(0).alias("pos"), F.lit("---").alias("line"))
    any_ = lines.limit(1).select(F.lit(1).alias("some"))
    return joined(lines.unionByName(rule.unionByName(calls).join(any_).drop("some")), ["part", "place", "pos"])


def code_edit(top: DataFrame) -> DataFrame:
    rows = first_per_name(top.where((F.col("place") <= 5) & F.col("type").isin("function", "class")))
    return joined(rows.select("place", _line(**_facts(), parametros=prop("parametros"), lineas=_lines()).alias("line")), ["place"], tail=ADVICE["code_edit"])


def _target(top: DataFrame) -> DataFrame:
    return top.where("place = 1")


def _callees(top: DataFrame, every: DataFrame) -> DataFrame:
    """Capsules that the target calls, in the order of its calls, repeats kept; a name means its last capsule."""
    calls = _target(top).select(F.posexplode("calls").alias("pos", "name"))
    order = F.struct("file_path", "start_line", "seq")
    last = every.join(calls.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.max_by(F.struct(*[c for c in every.columns if c != "name"]), order).alias("c"))
    return calls.join(last, "name").select("pos", "name", "c.*")


def _callers(top: DataFrame, every: DataFrame, most: int | None = None) -> DataFrame:
    """Capsules that call the target, in their order."""
    name = _target(top).select(F.col("name").alias("_t"))
    hit = every.join(name, F.array_contains(F.col("calls"), F.col("_t"))).drop("_t")
    return hit.orderBy("file_path", "start_line", "seq").limit(most) if most else hit


def _rows(df: DataFrame, part: int, line: Column, order: list[str]) -> DataFrame:
    """(part, o, line): o sorts as the order's columns do, numbers padded."""
    key = F.concat_ws("/", *[F.col(c) if c == "file_path" else F.lpad(F.col(c).cast("string"), 12, "0") for c in order])
    return df.select(F.lit(part).alias("part"), key.alias("o"), line.alias("line"))


def _whole(rows: list[DataFrame], tail: str = "") -> DataFrame:
    return joined(reduce(DataFrame.unionByName, rows), ["part", "o"], tail=tail)


ORDER = ["file_path", "start_line", "seq"]


def refactor(top: DataFrame, every: DataFrame) -> DataFrame:
    return _whole([
        _rows(_target(top), 0, _line(**_facts(), parametros=prop("parametros")), ["place"]),
        _rows(_callees(top, every), 1, _line(**_facts()), ["pos"]),
        _rows(_callers(top, every), 2, _line(**_facts()), ORDER),
    ])


def debug(top: DataFrame, every: DataFrame) -> DataFrame:
    body = F.when(F.length("content") > 3000, F.concat(F.substring("content", 1, 3000), F.lit(CUT_MARK))).otherwise(F.coalesce(F.nullif("content", F.lit("")), "signature"))
    return _whole([
        _rows(_target(top), 0, _line(**_facts(), content=body, parametros=prop("parametros"), tipo_retorno=prop("tipo_retorno"), lineas=_lines()), ["place"]),
        _rows(_callees(top, every), 1, _line(**_facts(), parametros=prop("parametros")), ["pos"]),
        _rows(_callers(top, every, 5), 2, _line(**_facts(), calls=_listed("calls", 8)), ORDER),
    ], ADVICE["debug"])


def test_gen(top: DataFrame, every: DataFrame) -> DataFrame:
    tests = every.where(F.contains(F.lower("name"), F.lit("test")) & F.col("type").isin("function", "class"))
    n = tests.agg(F.count("*").alias("n"))
    note = F.concat(F.col("n").cast("string"), F.lit(" tests existentes en el repo"))
    head = n.where("n > 0").select(F.lit(1).alias("part"), F.lit("").alias("o"), node_line(F.lit("__tests__"), F.lit("section"), pairs(descripcion=note)).alias("line"))
    text = _whole([
        _rows(_target(top), 0, _line(**_facts(), parametros=prop("parametros"), tipo_retorno=prop("tipo_retorno"), calls=_listed("calls", 8)), ["place"]),
        head,
        _rows(tests.orderBy(*ORDER).limit(8), 2, _line(**_facts()), ORDER),
    ], ADVICE["test_gen"])
    more = F.concat(F.lit(" Hay "), F.col("n").cast("string"), F.lit(" tests en el repo. Lee los mas relevantes con read_file."))
    return text.crossJoin(n).select(F.when((F.col("n") > 0) & (F.col("context") != ""), F.concat("context", more)).otherwise(F.col("context")).alias("context"))


def review(top: DataFrame) -> DataFrame:
    rest = top.where((F.col("place").between(2, 10)) & F.col("type").isin("function", "class", "async_function", "test"))
    return _whole([
        _rows(_target(top), 0, _line(**_facts(), parametros=prop("parametros"), tipo_retorno=prop("tipo_retorno"), lineas=_lines(), calls=_listed("calls", 8)), ["place"]),
        _rows(rest, 1, _line(**_facts(), calls=_listed("calls", 5)), ["place"]),
    ], ADVICE["review"])


CODE = ["function", "class", "async_function"]


def optimize(top: DataFrame, chars: int = 6000) -> DataFrame:
    """Up to five bodies of at most 2000 characters; the cost of one is the length of its shown values."""
    body = F.when(F.length("content") > 2000, F.concat(F.substring("content", 1, 2000), F.lit(CUT_MARK))).otherwise(F.coalesce("content", F.lit("")))
    rows = first_per_name(top.where(F.col("type").isin(CODE)))
    cost = F.length("signature") + F.length("file_path") + F.length(_doc()) + F.length(body) + F.length(_listed("calls", 8))
    rows = budget_prefix(rows, cost, chars).orderBy("place").limit(5)
    return joined(rows.select("place", _line(**_facts(), lineas=_lines(), calls=_listed("calls", 8), content=body).alias("line")), ["place"], tail=ADVICE["optimize"])


def audit(top: DataFrame) -> DataFrame:
    rows = first_per_name(top.where(F.col("type").isin(CODE))).orderBy("place").limit(10)
    return joined(rows.select("place", _line(**_facts(), parametros=prop("parametros"), calls=_listed("calls", 8)).alias("line")), ["place"], tail=ADVICE["audit"])


def directory_counts(every: DataFrame) -> DataFrame:
    """(dir, n): directories that hold files, with the number of capsules in them."""
    name = F.when(F.contains("file_path", F.lit("/")), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)).otherwise(".")
    return every.select(name.alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def ancestors(every: DataFrame) -> DataFrame:
    """(dir, n): every directory above a file, with the capsules below it."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return every.where(F.contains("file_path", F.lit("/"))).select(F.explode(above).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def code_tree(every: DataFrame) -> DataFrame:
    """(part, o, line): the lines of a tree of the repository: a title, directories, files with their language, totals. One row a line."""
    files = every.groupBy("file_path").agg(F.min_by("language", F.struct("start_line", "id")).alias("language"))
    line = lambda part, o, c: (F.lit(part).alias("part"), o.alias("o"), c.alias("line"))
    one, none = every.sparkSession.range(1), F.lit("")
    total = every.agg(F.count("*").alias("a")).crossJoin(files.agg(F.count("*").alias("b")))
    rows = [
        one.select(*line(0, none, F.lit("Estructura del repositorio:"))),
        ancestors(every).select(*line(1, F.col("dir"), F.concat(F.lit("  "), "dir", F.lit("/")))),
        files.select(*line(2, F.col("file_path"), F.concat(F.lit("  "), "file_path", F.lit(" ("), "language", F.lit(")")))),
        total.select(*line(3, none, F.concat(F.lit("\nTotal: "), F.col("b").cast("string"), F.lit(" archivos, "), F.col("a").cast("string"), F.lit(" capsulas")))),
        one.select(*line(4, none, F.lit("Usa search_code para explorar el codigo si necesitas detalles."))),
    ]
    return reduce(DataFrame.unionByName, rows)


def onboard(every: DataFrame) -> DataFrame:
    """Directories with their numbers of files, ten entry points, totals."""
    dirs = directory_counts(every)
    rows = [
        every.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("o"), F.lit("ESTRUCTURA DEL PROYECTO:").alias("line")),
        dirs.where("dir <> '.'").select(F.lit(1).alias("part"), F.col("dir").alias("o"), F.concat(F.lit("  "), "dir", F.lit("/ ("), F.col("n").cast("string"), F.lit(" archivos)")).alias("line")),
    ]
    entries = every.where(F.col("type").isin("entrypoint", "file_header")).orderBy(*ORDER).limit(10)
    rows.append(entries.limit(1).select(F.lit(2).alias("part"), F.lit("").alias("o"), F.lit("\nPUNTOS DE ENTRADA:").alias("line")))
    rows.append(_rows(entries, 3, F.concat(F.lit("  ["), "type", F.lit("] "), "name", F.lit(" — "), "file_path"), ORDER))
    total = every.agg(F.count("*").alias("a")).crossJoin(dirs.agg(F.count("*").alias("b")))
    rows.append(total.select(F.lit(4).alias("part"), F.lit("").alias("o"), F.concat(F.lit("\nTotal: "), F.col("a").cast("string"), F.lit(" capsulas, "), F.col("b").cast("string"), F.lit(" modulos\nUsa search_code y list_files para explorar en detalle.")).alias("line")))
    return _whole(rows)


def design_review(top: DataFrame, every: DataFrame) -> DataFrame:
    images = every.where("type = 'image'")
    pages = every.where(F.col("language").isin("html", "css"))
    shown = ["tags", "css_classes", "meta_tags", "headings", "selectors", "colors", "fonts", "media_queries"]
    n = images.agg(F.count("*").alias("i")).crossJoin(pages.agg(F.count("*").alias("p")))
    text = _whole([
        _rows(images.orderBy(*ORDER).limit(3), 0, _line(file_path=F.col("file_path"), mime=prop("mime"), size_bytes=prop("size_bytes")), ORDER),
        _rows(pages.orderBy(*ORDER).limit(5), 1, _line(file_path=F.col("file_path"), **{k: prop(k) for k in shown}), ORDER),
        _rows(top.where(F.col("language").isin("javascript", "typescript")).orderBy("place").limit(3), 2, _line(**_facts()), ["place"]),
    ])
    tail = F.concat(
        F.lit(ADVICE["design_review"]),
        F.when(F.col("i") > 0, F.concat(F.lit(" Hay "), F.col("i").cast("string"), F.lit(" imagen(es) para analizar. Revisa: paleta de colores, tipografía, espaciado, contraste, CTA, copy, estructura visual."))).otherwise(""),
        F.when(F.col("p") > 0, F.concat(F.lit(" "), F.col("p").cast("string"), F.lit(" archivo(s) HTML/CSS disponibles."))).otherwise(""),
    )
    return text.crossJoin(n).select(F.concat("context", tail).alias("context"))


def search_map(top: DataFrame, every: DataFrame, budget: int, dirs: list[str] | None = None) -> DataFrame:
    """Counts and names of undocumented code, then files with up to ten capsules each, while the budget lasts.

    Files of ranked capsules come first, then by path. A file that does not fit ends the map; a capsule that does not
    fit ends its file only, so later files may still fit: a fold over the candidate lines, which are cut beforehand
    to as many files as the budget can name.
    """
    rows = every
    if dirs:
        rows = rows.where(F.exists(F.array(*[F.lit(f"/{d.lower()}/") for d in dirs]), lambda d: F.contains(F.lower("file_path"), d)))
    code = F.col("type").isin("function", "class")
    n = rows.agg(F.sum((code & (_doc() == "")).cast("long")).alias("no"), F.sum((code & (_doc() != "")).cast("long")).alias("yes"), F.count("*").alias("n"), F.countDistinct("file_path").alias("f"))
    head = n.select(F.lit(0).alias("part"), F.lit("").alias("o"), F.concat(F.lit("RESUMEN: "), F.coalesce("no", F.lit(0)).cast("string"), F.lit(" funciones/clases SIN docstring, "), F.coalesce("yes", F.lit(0)).cast("string"), F.lit(" CON docstring.\nFUNCIONES SIN DOCSTRING:")).alias("line"))
    bare = rows.where(code & (_doc() == "")).orderBy(*ORDER).limit(30)
    bare = _rows(bare, 1, F.concat(F.lit("  ✗ ["), "type", F.lit("] "), "name", F.lit(" — "), "file_path"), ORDER)
    rest = n.sparkSession.range(1).select(F.lit(2).alias("part"), F.lit("").alias("o"), F.lit("\nMapa completo por archivo:").alias("line"))
    summary = head.unionByName(bare).unionByName(rest)
    used = summary.agg(F.sum(F.length(F.replace("line", F.lit("\n"), F.lit("")))).alias("c"))
    chars = budget * 4
    first = top.groupBy("file_path").agg(F.min("place").alias("rank"))
    files = rows.select("file_path").distinct().join(first, "file_path", "full").withColumn("rank", F.coalesce("rank", F.lit(1 << 30)))
    files = files.orderBy("rank", "file_path").limit(chars // 2 + 1)
    spot = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "seq"))
    caps = rows.join(files, "file_path").withColumn("k", spot).where("k <= 10").select("file_path", "rank", "k", F.concat(F.lit("  ["), "type", F.lit("] "), "name", F.when(_doc() != "", " ✓doc").otherwise(" ✗doc")).alias("line"))
    lines = caps.unionByName(files.select("file_path", "rank", F.lit(0).alias("k"), F.concat(F.lit("\n"), "file_path", F.lit(":")).alias("line")))
    listed = lines.agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "k", "line"))).alias("l")).crossJoin(used)
    room = F.greatest(F.lit(chars) - F.col("c"), F.floor(F.lit(chars) * 0.4))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(False).alias("over"), F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        size, is_file = F.length(r["line"]).cast("long"), r["k"] == 0
        fits = s["sum"] + size <= F.col("room")
        take = ~s["over"] & fits & (is_file | ~s["skip"])
        return F.struct(
            F.when(take, s["sum"] + size).otherwise(s["sum"]).alias("sum"),
            (s["over"] | (is_file & ~fits)).alias("over"),
            F.when(is_file, F.lit(False)).otherwise(s["skip"] | ~fits).alias("skip"),
            F.when(take, F.concat(s["out"], F.array(r["line"]))).otherwise(s["out"]).alias("out"),
        )

    body = listed.withColumn("room", room).select(F.posexplode(F.aggregate("l", start, step)["out"]).alias("pos", "line"))
    end = n.select(F.lit(4).alias("part"), F.lit("").alias("o"), F.concat(F.lit("\nTotal: "), F.col("n").cast("string"), F.lit(" capsulas en "), F.col("f").cast("string"), F.lit(" archivos")).alias("line"))
    return _whole([summary, _rows(body, 3, F.col("line"), ["pos"]), end])


def compress(top: DataFrame, every: DataFrame, budget: int, task: str, query_text: str = "", dirs: list[str] | None = None) -> DataFrame:
    """The context of a request, one row: the renderer of the task, after a list of the first files."""
    if task == "no_code":
        docs = top.where("type = 'document'")
        has_docs = docs.limit(1).count() > 0
        chosen = docs if has_docs else top
        return query(_placed(chosen), budget if has_docs else max(budget, 800))
    top, every = _placed(top.where("type <> 'document'")), every.where("type <> 'document'")
    wanted = mentioned_framework(query_text)
    if wanted and "framework" in every.columns:
        own = (F.col("framework") == {"next": "nextjs"}.get(wanted, wanted)).cast("int")
        spot = F.row_number().over(Window.partitionBy("_own").orderBy("place"))
        top = top.withColumn("_own", own).withColumn("_k", spot).where((F.col("_k") <= 8) & (F.col("_own") == 1) | (F.col("_k") <= 15) & (F.col("_own") == 0))
        top = _placed(top.withColumn("place", (1 - F.col("_own")) * 1000 + F.col("_k")).drop("_own", "_k"))
    text = {
        "code_edit": lambda: code_edit(top),
        "search": lambda: search_map(top, every, budget, dirs),
        "refactor": lambda: refactor(top, every),
        "debug": lambda: debug(top, every),
        "test_gen": lambda: test_gen(top, every),
        "review": lambda: review(top),
        "optimize": lambda: optimize(top),
        "audit": lambda: audit(top),
        "onboard": lambda: onboard(every),
        "design_review": lambda: design_review(top, every),
    }.get(task, lambda: query(top, budget))()
    files = top.where(F.col("place") <= 8).groupBy("file_path").agg(F.min("place").alias("p"))
    files = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "file_path"))), lambda r: r.file_path), ", ").alias("f"))
    return text.crossJoin(files).select(F.when((F.col("f") != "") & (F.col("context") != ""), F.concat(F.lit("ARCHIVOS: "), "f", F.lit("\n\n"), "context")).otherwise(F.col("context")).alias("context"))


def _placed(top: DataFrame) -> DataFrame:
    return top.withColumn("place", F.row_number().over(Window.orderBy("place")))
