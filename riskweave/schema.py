"""Declared schemas, value rules and column roles of the credit data.

Every reader, validator and feature stage takes its columns from here, so the
training table, scoring files, JSON records and the prediction log agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Field(NamedTuple):
    name: str
    dtype: T.DataType
    low: float | None = None
    high: float | None = None


# Field names, types and allowed ranges of a credit record.
REQUEST_FIELDS = [
    Field("tipo_credito", T.StringType()),
    Field("fecha_prestamo", T.TimestampType()),
    Field("capital_prestado", T.DoubleType(), 0),
    Field("plazo_meses", T.IntegerType(), 1, 120),
    Field("edad_cliente", T.IntegerType(), 18, 99),
    Field("tipo_laboral", T.StringType()),
    Field("salario_cliente", T.DoubleType(), 0),
    Field("total_otros_prestamos", T.DoubleType(), 0),
    Field("cuota_pactada", T.DoubleType(), 0),
    Field("puntaje", T.DoubleType()),
    Field("puntaje_datacredito", T.DoubleType()),
    Field("cant_creditosvigentes", T.IntegerType(), 0),
    Field("huella_consulta", T.IntegerType(), 0),
    Field("saldo_mora", T.DoubleType(), 0),
    Field("saldo_total", T.DoubleType(), 0),
    Field("saldo_principal", T.DoubleType(), 0),
    Field("saldo_mora_codeudor", T.DoubleType(), 0),
    Field("creditos_sectorFinanciero", T.IntegerType(), 0),
    Field("creditos_sectorCooperativo", T.IntegerType(), 0),
    Field("creditos_sectorReal", T.IntegerType(), 0),
    Field("promedio_ingresos_datacredito", T.DoubleType()),
    Field("tendencia_ingresos", T.StringType()),
]

KEY = "loan_id"
TARGET = "Pago_atiempo"
CORRUPT = "_corrupt_record"

REQUEST_COLUMNS = [f.name for f in REQUEST_FIELDS]
BOUNDED_FIELDS = [f for f in REQUEST_FIELDS if f.low is not None or f.high is not None]

# The thirteen scaled and three one-hot encoded feature columns.
NUMERIC_FEATURES = [
    "saldo_principal",
    "saldo_mora",
    "puntaje_datacredito",
    "edad_cliente",
    "antiguedad_credito_meses",
    "capital_prestado",
    "plazo_meses",
    "salario_cliente",
    "total_otros_prestamos",
    "cuota_pactada",
    "huella_consulta",
    "cant_creditosvigentes",
    "creditos_sectorFinanciero",
]
CATEGORICAL_FEATURES = ["mes_prestamo", "tipo_credito", "tipo_laboral"]

# Columns removed before and after the derived features are built.
SPARSE_COLUMNS = ["tendencia_ingresos", "promedio_ingresos_datacredito"]
UNUSED_COLUMNS = [
    "fecha_prestamo",
    "creditos_sectorCooperativo",
    "creditos_sectorReal",
    "puntaje",
    "saldo_mora_codeudor",
    "saldo_total",
]

# Imputed columns, age limit, excluded credit types.
MEDIAN_COLUMNS = ["saldo_principal", "saldo_mora"]
MEAN_COLUMNS = ["puntaje_datacredito"]
AGE_LIMIT = 100
EXCLUDED_CREDIT_TYPES = ["7", "68"]

# Raw inputs the feature stages cannot do without.
REQUIRED_COLUMNS = [
    "tipo_credito",
    "fecha_prestamo",
    "tipo_laboral",
    *[c for c in NUMERIC_FEATURES if c != "antiguedad_credito_meses"],
]

# Features promoted to columns of the prediction log, in drift-report order.
LOGGED_FEATURES = [
    "capital_prestado",
    "plazo_meses",
    "edad_cliente",
    "salario_cliente",
    "puntaje_datacredito",
]

CREDIT_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType())]
    + [T.StructField(f.name, f.dtype) for f in REQUEST_FIELDS]
    + [T.StructField(TARGET, T.IntegerType())]
)

# Text form of the same columns: files are read as text and typed in one place.
RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in [KEY, *REQUEST_COLUMNS, TARGET]]
    + [T.StructField(CORRUPT, T.StringType())]
)

PREDICTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("input_data", T.StringType(), False),
        T.StructField("prediction", T.IntegerType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("risk_level", T.StringType(), False),
        T.StructField("capital_prestado", T.DoubleType()),
        T.StructField("plazo_meses", T.IntegerType()),
        T.StructField("edad_cliente", T.IntegerType()),
        T.StructField("salario_cliente", T.DoubleType()),
        T.StructField("puntaje_datacredito", T.DoubleType()),
    ]
)
