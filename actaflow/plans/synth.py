"""Gazette announcements rendered from the events table.

Every text is a concatenation of columns, so that each fact in it is also known
without reading it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.operators.tables import shared_folder, spread

PEOPLE = "ALFA BRAVO CHARLIE DELTA ECO FOXTROT GOLF HOTEL INDIA JULIETT KILO LIMA MIKE NOVEMBER OSCAR PAPA QUEBEC ROMEO SIERRA TANGO".split()
LABELS = ("Adm. Unico", "Consejero", "Apoderado", "Auditor", "Adm. Solid.", "Secretario")
PROVINCES = 5


def _pick(values: tuple | list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def _money(cents: Column) -> Column:
    whole = F.translate(F.format_number((cents - F.pmod(cents, F.lit(100))) / 100, 0), ",", ".")
    return F.concat(whole, F.lit(","), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"), F.lit(" Euros"))


def announcements(spark: SparkSession, sf_dir: str, renames: bool = False) -> DataFrame:
    """doc_id, num, province, day, firm, raw_text of each event.

    With ``renames``, of every 31st text the company (of two in three users) takes the name of the next user."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value", "props"))
    u, n = F.col("user_id"), F.col("event_id")
    e = e.withColumns(
        {
            "day": F.to_date("ts"),
            "k": F.regexp_extract("props", "([0-9]+)", 1).cast("long"),
            "cents": F.floor(F.col("value") * 100 + F.lit(1e-6)).cast("long"),
        }
    )
    k, base = F.col("k"), F.concat(F.lit("EMPRESA "), u.cast("string"))
    firm = _pick7(base, n)
    officer = F.concat(_pick(LABELS, k), F.lit(": PERSONA "), _pick(PEOPLE, k), F.lit(". "))
    main = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Constitución. Comienzo de operaciones: 1.01.24. Objeto social: COMERCIO AL POR MENOR "), k.cast("string"), F.lit(". Domicilio: CL EJEMPLO "), k.cast("string"), F.lit(" (MADRID). Capital: "), _money(F.col("cents")), F.lit(". ")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Ampliación de capital. Capital: 10,00 Euros. Resultante Suscrito: "), _money(F.col("cents")), F.lit(". ")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Nombramientos. "), officer))
        .when(F.col("event_type") == "click", F.concat(F.lit("Ceses/Dimisiones. "), officer))
        .otherwise(F.concat(F.lit("Cambio de domicilio social. CL EJEMPLO "), k.cast("string"), F.lit(" (TOLEDO). ")))
    )
    before = F.when(n % 13 == 0, "Página web de la sociedad. WWW EJEMPLO").when(n % 17 == 0, "Fe de erratas. Se corrige el texto. - ").otherwise("")
    owner = F.when(n % 6 == 0, F.concat(F.lit("Declaración de unipersonalidad. Socio único: EMPRESA "), ((u * 7) % F.lit(n_users(spark, sf_dir))).cast("string"), F.lit(" SL. "))).otherwise("")
    end = F.when(n % 97 == 0, "Extinción. ").when(n % 89 == 0, "Disolución. Voluntaria. ").otherwise("")
    if renames:
        end = F.concat(F.when((n % 31 == 0) & (u % 3 != 2), F.concat(F.lit("Cambio de denominación social. EMPRESA "), (u + 1).cast("string"), F.lit(" SL. "))).otherwise(""), end)
    inscribed = F.date_sub(F.col("day"), (n % 15).cast("int"))
    sheet = F.when(n % 11 == 0, "").otherwise(F.concat(F.lit(", H M "), u.cast("string")))
    tail = F.concat(F.lit("Datos registrales. S 8 "), sheet, F.lit(", I/A 3 ("), F.date_format(inscribed, "d.MM.yy"), F.lit(")."))
    return e.select(
        F.concat(F.lit("GZ-A-"), F.date_format("day", "yyyyMMdd"), F.lit("-"), F.lpad((u % PROVINCES).cast("string"), 2, "0")).alias("doc_id"),
        n.alias("num"), F.concat(F.lit("PROVINCE "), (u % PROVINCES).cast("string")).alias("province"), "day", firm.alias("firm"),
        F.concat(before, main, owner, end, tail).alias("raw_text"),
    )


def _pick7(base: Column, n: Column) -> Column:
    lower = F.concat(F.lit("Empresa "), F.substring_index(base, " ", -1))
    forms = (
        F.concat(base, F.lit(" SL")), F.concat(base, F.lit(", S.L.")), F.concat(lower, F.lit(" Sociedad Limitada")),
        F.concat(base, F.lit(" S. L. U.")), F.concat(F.regexp_replace(base, "EMPRESA", "EMPRÉSA"), F.lit(" SL EN LIQUIDACION")),
        F.concat(base, F.lit(" SL (R.M. CIUDAD)")), F.concat(base, F.lit(" SL (2019)")),
    )
    # of an array all forms would be made for each row
    form = F.lit(None).cast("string")
    for i, made in enumerate(forms):
        form = F.when(F.pmod(n, F.lit(7)) == i, made).otherwise(form)
    return form


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id of every user of the events table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()


def n_users(spark: SparkSession, sf_dir: str) -> int:
    """One more than the largest user."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.coalesce(F.max("user_id"), F.lit(0)) + 1).first()[0]


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth user: company_id, group_id, name_key, name, incorporated, record columns."""
    u = F.col("id")
    return users(spark, sf_dir).filter(u % 10 == 0).select(
        u.alias("company_id"), (u % 3).alias("group_id"), (u == 0).alias("is_head"),
        F.concat(F.lit("EMPRESA "), u.cast("string"), F.lit(" SL")).alias("name_key"),
        F.concat(F.lit("EMPRESA "), u.cast("string"), F.lit(" SL")).alias("name"),
        F.when(u % 20 == 0, F.to_date(F.lit("2024-04-20"))).alias("incorporated"),
        F.concat(F.lit("CALLE EJEMPLO "), (u % 40).cast("string")).alias("address"), F.lit("MADRID").alias("city"),
        F.lit("100.00").cast("decimal(18,2)").alias("capital"), F.lit(None).cast("string").alias("purpose"), F.lit("active").alias("status"),
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets known at the start: every thirtieth user."""
    u = F.col("id")
    return users(spark, sf_dir).filter(u % 30 == 0).select(F.concat(F.lit("PROVINCE "), (u % PROVINCES).cast("string")).alias("province"), F.concat(F.lit("M "), u.cast("string")).alias("sheet"), u.alias("company_id"))


def documents(announcements: DataFrame, heading: str | None = None, most: int | None = None) -> DataFrame:
    """Landed documents of announcements (doc_id, num, province, day, header, body), in the
    shape of the XML files; section B has a ``heading`` above each announcement.  One of more
    than about ``most`` announcements is printed in parts, each with pages of its own."""
    text = lambda css, value: F.struct(F.lit(css).alias("_class"), value.alias("_VALUE"))
    own = [text("centro_redonda", F.lit(heading))] if heading else []
    each = F.struct("num", F.array(*own, text("articulo", F.col("header")), text("parrafo", F.col("body"))).alias("p"))
    part = F.lit(0)
    if most:
        sizes = announcements.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
        announcements, part = announcements.join(sizes, "doc_id"), F.pmod(F.xxhash64("num"), F.col("_parts")).cast("int")
    docs = announcements.groupBy("doc_id", "province", "day", part.alias("part")).agg(F.array_sort(F.collect_list(each)).alias("a"))
    about = F.struct(
        F.col("doc_id").alias("identificador"), F.col("province").alias("titulo"), F.lit("GACETA").alias("diario"), F.lit(1).alias("diario_numero"),
        F.date_format("day", "yyyyMMdd").alias("fecha_publicacion"), (2 * F.col("part") + 1).alias("pagina_inicial"), (2 * F.col("part") + 2).alias("pagina_final"), F.lit("").alias("url_pdf"),
    )
    return docs.select(about.alias("metadatos"), F.struct(F.flatten(F.transform("a", lambda x: x["p"])).alias("p")).alias("texto"))


INDEX = "https://gazette.invalid/index/{day}"


def fill_store(spark: SparkSession, sf_dir: str) -> str:
    """The root of a landing store that holds the documents and daily indexes of the events, as
    runs of ``sources.landing`` would leave it."""
    root = shared_folder(spark, "store").replace("file:/", "file:///", 1).replace("file://///", "file:///")
    a = announcements(spark, sf_dir).withColumn("header", F.concat(F.col("num").cast("string"), F.lit(" - "), F.col("firm"))).withColumnRenamed("raw_text", "body")
    url = F.concat(F.lit("https://gazette.invalid/xml/"), F.col("metadatos.identificador"), F.lit(".xml"))
    documents_ = documents(a).select(url.alias("url"), F.to_xml(F.struct("metadatos", "texto"), {"rowTag": "documento"}).alias("text"))
    item = F.struct(F.col("doc_id").alias("identificador"), F.col("province").alias("titulo"), F.concat(F.lit("https://gazette.invalid/xml/"), "doc_id", F.lit(".xml")).alias("url_xml"))
    items = a.groupBy("day").agg(F.collect_set(item).alias("item"))
    paper = F.struct(F.struct(F.lit("A").alias("codigo"), "item").alias("seccion"))
    body = F.to_json(F.struct(F.struct(F.struct(paper.alias("diario")).alias("sumario")).alias("data")))
    indexes = items.select(F.regexp_replace(F.lit(INDEX), r"\{day\}", F.date_format("day", "yyyyMMdd")).alias("url"), body.alias("text"))

    def put(batches):
        from actaflow.sources.landing import Store

        store = Store(root)
        for batch in batches:
            for url, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                store.put(url, text.as_py().encode())
            yield batch.slice(0, 0).select(["url"])

    documents_.unionByName(indexes).mapInArrow(put, "url string").count()
    return root


def landed(spark: SparkSession, sf_dir: str, sections: tuple[str, ...] = ("A", "B"), most: int | None = None) -> str:
    """A folder of documents of both sections, written from the events: section B lists one
    company, and every fourth time another one with it, with the day of a deposit."""
    folder = shared_folder(spark, "landed")
    a = announcements(spark, sf_dir).withColumn("header", F.concat(F.col("num").cast("string"), F.lit(" - "), F.col("firm"))).withColumnRenamed("raw_text", "body")
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("day", F.to_date("ts"))
    listed = F.concat(F.lit("EMPRESA "), u, F.lit(" SL"), F.when(n % 4 == 0, F.concat(F.lit("; OTRA "), u, F.lit(" SA"))).otherwise(""), F.date_format("day", " (dd/MM/yyyy)"))
    b = e.select(
        F.concat(F.lit("GZ-B-"), F.date_format("day", "yyyyMMdd"), F.lit("-00")).alias("doc_id"), n.alias("num"), F.lit("PROVINCE 0").alias("province"), "day",
        F.concat(n.cast("string"), F.lit(" - "), listed).alias("header"), F.concat(F.lit("Proyecto "), F.col("event_type"), F.lit(".")).alias("body"),
    )
    for section, rows, heading in (("A", a, None), ("B", b, "Depósitos de proyectos de fusión.")):
        if section in sections:
            documents(rows, heading, most).write.format("xml").option("rootTag", "documentos").option("rowTag", "documento").mode("append").save(f"{folder}/{section}")
    return folder
