"""The code catalog: reader for its ragged CSV, and the built-in catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.session import literal_table

CSV_SCHEMA = "code_bps LONG, name_es STRING, name_en STRING, cie10 STRING, target STRING"

# Record code | group of the international classification | T for targets.
CATALOG_TEXT = """\
101|B20|
201|C14|
202|C16|
203|C18-C20|
204|C22|
205|C25|
206|C34|
207|C73|
208|C40-C41|
209|C43|
210|C50|
211|C55|
212|C53|
213|C56|
214|C61|
215|C62|
216|C64-C65|
217|C67|
218|C81|
219|C82-C85|
220|C91-C95|
221|C88|
222|C46|
401|E10-E14|
402|E78|
403|E03|
404|E66|
500|F01-F03|
501|F09|
502|F10|
503|F17|
504|F19|
505|F20|
506|F30-F39|
507|F40-F41|
508|F50|
509|F48|
510|F60-F69|
511|F70-F79|
512|F84|
513|F89|
514|F90-F98|
601|G40-G41|
602|G20|
603|G25|
604|G80-G83|
701|H35.3|
702|H40-H42|
703|H35|T
901|I60-I64|
902|I67-I69|
903|G45|
904|I65|
905|I69|
906|I70|
907|I74|
908|I71|
909|I48|
910|I20-I25|T
911|I34-I38|
912|Q20-Q28|
913|I10-I15|
914|I50|
1001|J44|
1002|J45|
1101|K73|
1102|K76.0|
1103|K74|
1104|K21|
1105|K50-K51|
1106|K90.4|
1201|L40|
1202|L20|
1301|M81|
1302|M15-M19|
1303|M10|
1304|M13|
1305|M05-M06|
1306|M30-M31|
1307|M79.7|
1401|N18|T
1402|N20|
1999|Z89|T
"""


def catalog_rows() -> list[tuple[int, str, str | None]]:
    """(code_bps, cie10, target) of the built-in catalog; names are in the CSV of :func:`read_catalog`."""
    rows = []
    for line in CATALOG_TEXT.splitlines():
        code, group, target = line.split("|")
        rows.append((int(code), group, target or None))
    return rows


def builtin_catalog(spark: SparkSession) -> DataFrame:
    return literal_table(spark, catalog_rows(), "code_bps LONG, cie10 STRING, target STRING")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog CSV; lines without the trailing target field are kept with a null target."""
    return spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "PERMISSIVE").option(
        "enforceSchema", True
    ).csv(path)


def target_groups(catalog: DataFrame) -> DataFrame:
    """(code) of the catalog groups that are prediction targets."""
    return catalog.where("target IS NOT NULL").select(F.col("cie10").alias("code")).distinct()


def column_codes(catalog: DataFrame) -> list[str]:
    """Sorted group names: the pivot columns of a wide table. The catalog is a schema, not data."""
    return sorted(r[0] for r in catalog.select("cie10").distinct().collect())
