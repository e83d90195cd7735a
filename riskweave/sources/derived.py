"""Credit table and prediction log derived from the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import null_if_nan
from riskweave.schema import KEY, REQUEST_COLUMNS, TARGET

# Reference dates of the derived data: the day credit age is measured on, and
# the moment the log is read.
CREDIT_AS_OF = "2001-09-01"
LOG_AS_OF = "2024-01-31 00:00:00"

_CUSTOMER_COLUMNS = {
    "edad_cliente",
    "tipo_laboral",
    "salario_cliente",
    "promedio_ingresos_datacredito",
    "tendencia_ingresos",
}
_LINE_COLUMNS = {
    "cant_creditosvigentes",
    "saldo_mora",
    "saldo_total",
    "saldo_principal",
    "creditos_sectorFinanciero",
    "creditos_sectorCooperativo",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items rolled up per order before they meet the orders."""
    line = table(spark, sf_dir, "lineitem")
    is_open = F.col("l_linestatus") == "O"
    return line.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(is_open, 1).otherwise(0)).alias("n_open"),
        F.sum("l_quantity").alias("total_qty"),
        F.sum(F.when(is_open, F.col("l_quantity")).otherwise(0.0)).alias("open_qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned_qty"),
    )


def credit_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The credit table; only the joins that the requested columns need are made."""
    wanted = [KEY, *(columns if columns is not None else [*REQUEST_COLUMNS, TARGET])]
    wanted = list(dict.fromkeys(wanted))
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    if _LINE_COLUMNS & set(wanted):
        rows = rows.join(
            _line_totals(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left"
        )
    k = F.col("o_orderkey")
    urgency = F.substring("o_orderpriority", 1, 1)
    has_income = F.col("c_custkey") % 3 != 0
    expressions = {
        KEY: k,
        "tipo_credito": F.when(urgency == "1", "04")
        .when(urgency == "2", "6")
        .when(urgency == "3", "12")
        .when(urgency == "4", F.when(k % 4 == 0, "7").otherwise("04"))
        .otherwise(F.when(k % 4 == 0, "68").otherwise("12")),
        "fecha_prestamo": F.col("o_orderdate"),
        "capital_prestado": F.col("o_totalprice"),
        "plazo_meses": (1 + k % 120).cast("int"),
        "edad_cliente": (18 + F.col("c_custkey") % 90).cast("int"),
        "tipo_laboral": F.when(
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"), "Empleado"
        ).otherwise("Independiente"),
        "salario_cliente": F.col("c_acctbal") * 1000,
        "total_otros_prestamos": (k % 13).cast("double") * 100000,
        "cuota_pactada": F.col("o_totalprice") / (1 + k % 120),
        "puntaje": (k % 101).cast("double"),
        "puntaje_datacredito": F.when(k % 17 != 0, (300 + (k * 37) % 651).cast("double")),
    }
    if _LINE_COLUMNS & set(wanted):
        expressions |= {
            "cant_creditosvigentes": F.coalesce("n_lines", F.lit(0)).cast("int"),
            "saldo_mora": F.col("returned_qty"),
            "saldo_total": F.col("total_qty"),
            "saldo_principal": F.col("open_qty"),
            "creditos_sectorFinanciero": F.coalesce("n_open", F.lit(0)).cast("int"),
            "creditos_sectorCooperativo": F.coalesce(F.col("n_lines") - F.col("n_open"), F.lit(0)).cast("int"),
        }
    expressions |= {
        "huella_consulta": (k % 10).cast("int"),
        "saldo_mora_codeudor": F.lit(0.0),
        "creditos_sectorReal": F.lit(0),
        "promedio_ingresos_datacredito": F.when(has_income, F.col("c_acctbal") * 900),
        "tendencia_ingresos": F.when(
            has_income, F.when(F.col("c_custkey") % 3 == 1, "Creciente").otherwise("Decreciente")
        ),
        TARGET: F.when((k * 37) % 651 < 60, 0)
        .when((k % 10 > 7) & (F.col("o_orderstatus") == "F"), 0)
        .when((k * 7) % 50 == 0, 0)
        .otherwise(1)
        .cast("int"),
    }
    picked = rows.select(*[expressions[c].alias(c) for c in wanted])
    doubles = {name for name, kind in picked.dtypes if kind == "double"}
    return picked.select(*[null_if_nan(F.col(c)).alias(c) if c in doubles else F.col(c) for c in wanted])


def fixed_score(df: DataFrame, multiplier: int = 7919, key: str = KEY) -> DataFrame:
    """Append a repeatable score and prediction that any engine computes alike."""
    score = ((F.col(key) * multiplier) % 1000).cast("double") / 1000
    return df.withColumn("score", score).withColumn("prediction", (score >= 0.5).cast("int"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a prediction log."""
    event = table(spark, sf_dir, "events")
    step = (F.col("event_id") * 7919) % 1000
    return event.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("props").alias("input_data"),
        F.when(step >= 500, 1).otherwise(0).alias("prediction"),
        (step.cast("double") / 1000).alias("probability"),
        F.when(step >= 800, "Bajo")
        .when(step >= 600, "Medio-Bajo")
        .when(step >= 400, "Medio")
        .when(step >= 200, "Alto")
        .otherwise("Muy Alto")
        .alias("risk_level"),
        (F.col("value") * 10000).alias("capital_prestado"),
        (1 + F.get_json_object("props", "$.k").cast("int")).cast("int").alias("plazo_meses"),
        (18 + F.col("user_id") % 60).cast("int").alias("edad_cliente"),
        F.when(F.col("event_type") == "error", F.lit(None))
        .otherwise((1000000 + F.col("user_id") * 10000).cast("double"))
        .alias("salario_cliente"),
        F.when(F.col("event_type") == "signup", F.lit(None))
        .otherwise(
            (
                300
                + (F.col("event_id") * 37) % 600
                + F.when(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-28 00:00:00")), 120).otherwise(0)
            ).cast("double")
        )
        .alias("puntaje_datacredito"),
    )
