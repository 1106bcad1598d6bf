"""evidra: clinical-evidence analytics as Spark DataFrame operators."""
