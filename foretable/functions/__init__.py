"""Column functions: from columns to a column, all evaluated in the JVM."""
