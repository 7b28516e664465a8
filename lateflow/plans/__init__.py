"""Named jobs, the SQL oracle and fact materialisation."""
