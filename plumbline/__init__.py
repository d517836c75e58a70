"""plumbline: document contracts evaluated as Spark DataFrame operators."""
