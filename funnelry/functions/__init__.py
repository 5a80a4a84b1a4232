"""Column expressions; nothing here touches a DataFrame except through its columns."""
