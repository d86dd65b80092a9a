"""Framework rules: ordered rules that may retype a capsule and name its framework.

What a rule tests of the text is one boolean column; the rules then fold over a small state (type, framework) in an
array aggregate. So a later rule sees what earlier ones changed, yet no expression repeats another, and nothing leaves
the JVM. Rules of one chain are alternatives: the first that holds closes the chain.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import contains_any
from lodeseek.schema import prop

C = F.col


def has(*parts: str) -> Column:
    return contains_any(F.coalesce(C("content"), F.lit("")), list(parts))


def low(*parts: str) -> Column:
    return contains_any(F.lower(F.coalesce(C("content"), F.lit(""))), list(parts))


def deco(*parts: str) -> Column:
    return contains_any(F.lower(C("_deco")), list(parts))


def base(*parts: str) -> Column:
    return contains_any(C("_base"), list(parts))


def lang(*names: str) -> Column:
    return C("language").isin(*names)


JS, JVM = ("javascript", "typescript"), ("java", "kotlin")
FUNCTIONS = ("function", "async_function")


def rule(chain: int, test: Column, to: str | Column = "", frame: str | Column = "", types=(), to_types=(), only: bool = False, default: bool = False, last: bool = False) -> Column:
    """types: the rule holds for these types only (empty: all). to_types: the new type applies to these only. only: the
    framework comes only with the new type. default: only if there is none yet. last: no rule after it."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = lambda t: F.array(*[F.lit(x) for x in t]) if t else F.array().cast("array<string>")
    parts = {"chain": F.lit(chain), "flag": F.coalesce(test, F.lit(False)), "to": text(to), "frame": text(frame), "types": names(types), "to_types": names(to_types), "only": F.lit(only), "default": F.lit(default), "last": F.lit(last)}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def pick(test: Column, yes: str, no: str = "") -> Column:
    return F.when(test, F.lit(yes)).otherwise(F.lit(no))


def rules() -> list[Column]:
    py, js, jvm = lang("python"), lang(*JS), lang(*JVM)
    jsx = has("return (", "return <", "React.FC", "useState(", "props.", "export default")
    handlers = "@shared_task", "@app.task"
    chains = [
        [(py & has("web.Application("), {"frame": "aiohttp"})],
        [
            (py & (has("@routes.get", "@routes.post") | deco("routes.get", "routes.post")), {"to": "endpoint", "frame": "aiohttp", "last": True}),
            (py & deco("router.get(", "router.post(", "router.put(", "router.delete(", "router.patch(", ".get(", ".post("), {"to": "endpoint", "frame": "fastapi", "to_types": FUNCTIONS, "only": True}),
            (py & deco(".route(", "app.route", "bp.route"), {"to": "endpoint", "frame": "flask"}),
            (py & base("BaseModel"), {"to": "model", "frame": "pydantic", "types": ("class",)}),
            (py & base("Model)", "models.Model"), {"to": "model", "frame": "django", "types": ("class",)}),
            (py & base("db.Model"), {"to": "model", "frame": "sqlalchemy", "types": ("class",)}),
        ],
        [
            (js & F.rlike("name", F.lit(r"^\p{Lu}")), {"to": pick(jsx, "component"), "frame": pick(jsx, "react"), "types": ("function",)}),
            (js & low("use client"), {"to": "component", "frame": "nextjs"}),
            (js & has("export async function") & low("request", "response", "params"), {"to": "endpoint", "frame": "nextjs"}),
        ],
        [(lang("typescript") & has("@Controller", "@Module(", "@Injectable(", "@Get("), {"to": pick(has("@Get", "@Post"), "endpoint", "controller"), "frame": "nestjs"})],
        [(lang("javascript") & low("app.get(", "app.post(", "router.get(", "express.router"), {"to": "endpoint", "frame": "express"})],
        [
            (jvm & has("@RestController", "@Controller"), {"to": pick(has("@GetMapping", "@PostMapping"), "endpoint", "controller"), "frame": "spring"}),
            (jvm & has("@Service", "@Repository"), {"frame": "spring"}),
            (jvm & has("@SpringBootApplication"), {"to": "entrypoint", "frame": "spring"}),
        ],
        [(lang("php") & has("Route::", "Illuminate\\", "Eloquent"), {"frame": "laravel"})],
        [(lang("php") & has("Route::get", "Route::post"), {"to": "endpoint", "frame": "laravel"})],
        [(lang("csharp") & (has("[ApiController]") | base("ControllerBase")), {"to": "controller", "frame": "dotnet"})],
        [(lang("csharp") & has("[Route(", "[HttpGet"), {"to": "endpoint"})],
        [(has("type Query", "type Mutation", "graphql") | lang("graphql"), {"to": pick(has("type "), "schema"), "frame": "graphql"})],
        [(F.contains(F.lower("file_path"), F.lit(".proto")) | (has("service ") & has("rpc ")), {"to": pick(has("service "), "schema"), "frame": "grpc"})],
        [(py & (has(*handlers) | deco("shared_task", "app.task")), {"to": "task", "frame": "celery", "types": FUNCTIONS})],
        [(py & contains_any(C("_deco"), ["@routes.get", "@routes.post"]), {"to": "endpoint", "frame": "aiohttp"})],
        [(py & (base("SQLModel") | (has("table=True") & has("SQLModel"))), {"to": "model", "frame": "sqlmodel", "types": ("class",)})],
        [(py & (has("@strawberry.type", "strawberry.Schema") | deco("strawberry.type")), {"to": "schema", "frame": "strawberry", "to_types": ("class",)})],
        [(js & has("defineComponent", "ref(", "reactive(", "computed(", "<template>", "createApp(", "useRouter("), {"to": "component", "frame": "vue", "types": ("function", "class")})],
        [(js & has("<script setup", "<style scoped>"), {"to": "component", "frame": "vue"})],
        [(js & has("@Component(", "@Injectable(", "@Pipe(", "@NgModule(", "@Directive("), {"to": F.when(has("@Injectable"), "controller").when(has("@Pipe"), "").otherwise("component"), "frame": "angular"})],
        [(js & has("$:", "onMount(", "onDestroy(", "createEventDispatcher", "<script>"), {"to": "component", "frame": "svelte"})],
        [(js & has("useFetch(", "useAsyncData(", "definePageMeta", "useRuntimeConfig("), {"to": "component", "frame": "nuxt"})],
        [(js & has("export async function loader", "export async function action"), {"to": "endpoint", "frame": "remix"})],
        [
            (lang("ruby") & (has("ApplicationController") | base("ApplicationController")), {"to": "controller", "frame": "rails"}),
            (lang("ruby") & (has("ApplicationRecord") | base("ApplicationRecord")), {"to": "model", "frame": "rails"}),
            (lang("ruby") & has("ActiveRecord::Migration"), {"to": "function", "frame": "rails"}),
        ],
        [(lang("ruby") & (F.rlike("content", F.lit(r"(?:get|post|put|delete|patch)\s+['\"]/")) | has("Sinatra::Base")), {"to": "endpoint", "frame": "sinatra"})],
        [(lang("go") & has("gin.Context", "gin.H{"), {"to": pick(has("gin.Context"), "endpoint"), "frame": "gin", "to_types": ("function",)})],
        [(lang("go") & has("echo.Context", "echo.New("), {"to": pick(has("echo.Context"), "endpoint"), "frame": "echo", "to_types": ("function",)})],
        [(lang("go") & has("fiber.Ctx", "fiber.New("), {"to": pick(has("fiber.Ctx"), "endpoint"), "frame": "fiber", "to_types": ("function",)})],
        [(jvm & has("@Entity", "@Table("), {"to": "model", "frame": "hibernate"})],
        [(jvm & has('@Path("', "jakarta.ws.rs"), {"to": pick(has("@GET", "@POST"), "endpoint", "controller"), "frame": "jakarta"})],
        [
            (jvm & (has("@QuarkusMain") | (has("@Path") & low("quarkus"))), {"to": "controller", "frame": "quarkus", "types": ("class", "dataclass")}),
            (jvm & (has("@QuarkusMain") | (has("@Path") & low("quarkus"))), {"to": "endpoint", "frame": "quarkus"}),
        ],
        [
            (lang("rust") & has("#[get", "#[post", "#[put", "#[delete", "HttpRequest"), {"to": "endpoint", "frame": "actix"}),
            (lang("rust") & has("HttpResponse", "App::new()"), {"frame": "actix"}),
        ],
        [(lang("rust") & has("Router::new()", "axum::"), {"to": pick(low(".route("), "endpoint"), "frame": "axum", "to_types": ("function",)})],
        [(lang("php") & has("#[Route('/", "AbstractController", "Symfony\\"), {"to": pick(has("#[Route"), "endpoint"), "frame": "symfony", "to_types": ("function",)})],
        [(lang("csharp") & has("DbContext", "DbSet<", "OnModelCreating"), {"to": "model", "frame": "entity_framework"})],
        [(lang("elixir") & has("Phoenix.Controller", "Phoenix.LiveView"), {"to": pick(has("conn |> ") | low("redirect(conn"), "controller"), "frame": "phoenix"})],
    ]
    middleware = (py & F.contains(F.lower("name"), F.lit("middleware"))) | (js & low("next()", "res.status", "req.", "req.body"))
    out = [rule(i, test, **what) for i, chain in enumerate(chains) for test, what in chain]
    # The middleware rule retypes in any case, but names a framework only where there is none.
    return [*out, rule(len(chains), middleware, "middleware", pick(lang("javascript"), "express", "fastapi"), types=("function", "class"), default=True)]


def detect_frameworks(capsules: DataFrame) -> DataFrame:
    """capsules with types changed by the rules and the column framework ('' if none)."""
    df = capsules.withColumn("_deco", F.coalesce(prop("decorators"), F.lit(""))).withColumn("_base", F.coalesce(prop("hereda_de"), F.lit("")))
    start = F.struct(F.coalesce("type", F.lit("")).alias("type"), F.lit("").alias("framework"), F.lit(-1).alias("chain"), F.lit(False).alias("over"))

    def step(s: Column, r: Column) -> Column:
        fits = lambda types: (F.size(types) == 0) | F.array_contains(types, s["type"])
        holds = ~s["over"] & r["flag"] & (s["chain"] != r["chain"]) & fits(r["types"])
        typed = holds & (r["to"] != "") & fits(r["to_types"])
        named = holds & (r["frame"] != "") & (~r["only"] | typed) & (~r["default"] | (s["framework"] == ""))
        return F.struct(
            F.when(typed, r["to"]).otherwise(s["type"]).alias("type"),
            F.when(named, r["frame"]).otherwise(s["framework"]).alias("framework"),
            F.when(holds, r["chain"]).otherwise(s["chain"]).alias("chain"),
            (s["over"] | (holds & r["last"])).alias("over"),
        )

    df = df.withColumn("_end", F.aggregate(F.array(*rules()), start, step))
    kept = [F.col("_end")["type"].alias("type") if c == "type" else F.col(c) for c in capsules.columns]
    return df.select(*kept, F.col("_end")["framework"].alias("framework"))
