"""tracelake: process-event-log analytics as Spark DataFrame operators."""
