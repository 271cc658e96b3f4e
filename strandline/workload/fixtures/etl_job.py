from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast, udf

spark = SparkSession.builder.appName("shipments").getOrCreate()
ENV = "prod"
BASE = f"s3a://lake/{ENV}"


@udf("string")
def weight_class(kg):
    return "heavy" if kg and kg > 100 else "light"


def clean(df, column="kg"):
    return df.filter(F.col(column).isNotNull()).dropDuplicates(["shipment_id"])


shipments = spark.read.parquet(BASE + "/shipments/")
carriers = spark.table(f"{ENV}.dim.carriers")
rates = spark.read.format("jdbc").option("url", "jdbc:postgresql://rates-db:5432/rates").option("dbtable", "daily").option("password", "x").load()

shipments = clean(shipments)
priced = (
    shipments.join(broadcast(carriers), shipments.carrier_id == carriers.id, "left")
    .join(rates, ["currency"])
    .withColumn("cost", F.col("kg") * F.col("rate"))
    .withColumn("class", weight_class(F.col("kg")))
)
if ENV == "prod":
    chosen = priced.filter(F.col("cost") > 0)
else:
    chosen = priced.limit(100)

summary = priced.groupBy("carrier_id").agg(F.sum("cost").alias("total_cost"), F.count("shipment_id").alias("n"))
summary.createOrReplaceTempView("v_summary")
top = spark.sql("SELECT carrier_id, total_cost FROM v_summary WHERE total_cost > 10")
chosen.write.mode("overwrite").saveAsTable("mart.shipments_priced")
top.unionByName(spark.read.parquet("s3a://archive/top/"), allowMissingColumns=True).write.mode("append").parquet("s3a://gold/top/")

stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", "k2:9092,k1:9092").option("subscribe", "events").load()


def sink(batch, epoch):
    batch.write.format("delta").mode("append").saveAsTable("mart.events")


stream.writeStream.outputMode("append").foreachBatch(sink).start()
