"""How plans are cut, joined and dealt out; nothing here knows a query."""
