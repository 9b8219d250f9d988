"""Jobs over whole tables: dispatch, sessions, storing, searching and exporting."""
