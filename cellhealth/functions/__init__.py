"""Column expressions: no function here touches a DataFrame or leaves the JVM."""
