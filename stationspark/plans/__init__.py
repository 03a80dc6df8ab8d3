"""Ad-hoc SQL over registered views, and table views of results."""
